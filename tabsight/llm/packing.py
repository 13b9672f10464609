"""Best-fit packing of documents into fixed-length sequences, certified by lower bounds.

Texts become token pieces of at most one sequence. Pieces are dealt evenly into
parts; each part runs best-fit decreasing on its own and compares its number of
sequences with a lower bound from dual-feasible functions. While all parts
together use more sequences than the bound for all pieces, the loosest
sequences of every part with a gap give their pieces back, which are dealt
anew into fewer parts and packed again.

Defined cases: a null or empty text is one piece that holds only the end id;
repeated rows are packed once each; an empty table gives an empty result; other
columns of the documents are ignored.
"""

from __future__ import annotations

import functools
import json
import math
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import arrow_batches, stored, text_of

CAPACITY = 4096
END_ID = 1
PART_ROWS = 50_000  # pieces in a part: what one task packs at once
CACHE = 400_000  # distinct chunks whose ids a worker keeps
PIECE_CACHE = 1_000_000  # and distinct lower-case pieces of them
# Latin-1 letters have one lower-case form and one normal form; the ASCII marks after them, no apostrophe, are one piece.
PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]{1,64})([!-&(-/:-@[-`{-~]{0,8})")
NEVER = 1 << 60
PIECES = "piece int, start long, length long, ids binary"


class ChunkIds(dict):
    """Token ids (little-endian uint32 bytes) of chunks between ASCII white space, cached.

    The tokenizer drops white space and never joins across it, so the ids of a
    text are the ids of its chunks one after the other. Chunks that are plain
    Latin letters and closing punctuation are merged here by the tokenizer's own
    table, all others by the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, end = model["vocab"], model["end_of_word_suffix"]
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.inner = [vocabulary[letter[b]] for b in range(256)]
        self.last = [vocabulary[letter[b] + end] for b in range(256)]
        self.pieces: dict[str, bytes] = {}
        # pair of ids -> rank and id of what they make, in one number
        self.pairs: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            one, two = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(vocabulary[one] << 16 | vocabulary[two], rank << 16 | vocabulary[one + two])

    def __missing__(self, chunk: bytes) -> bytes:
        if len(self) > CACHE:
            self.clear()
        text = chunk.decode()
        plain = PLAIN.fullmatch(text)
        if plain:
            value = b"".join([self.piece(x) for x in plain.groups() if x])
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            value = struct.pack(f"<{len(ids)}I", *ids)
        self[chunk] = value
        return value

    def piece(self, text: str) -> bytes:
        text = text.lower()
        value = self.pieces.get(text)
        if value is None:
            ids = self.merged(text.encode())
            if len(self.pieces) > PIECE_CACHE:
                self.pieces = {}
            value = self.pieces[text] = struct.pack(f"<{len(ids)}I", *ids)
        return value

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank merges first, the leftmost of equals."""
        inner, get = self.inner, self.pairs.get
        ids = [inner[b] for b in piece]
        ids[-1] = self.last[piece[-1]]
        ranks = [get(a << 16 | b, NEVER) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [least & 0xFFFF]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 16 | ids[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 16 | ids[i], NEVER)
        return ids

    def __call__(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))


@functools.lru_cache(maxsize=2)
def chunk_ids(path: str) -> ChunkIds:
    return ChunkIds(path)


def token_pieces(docs: DataFrame, tokenizer: str, text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids): the ids of each text and the end id, cut only beyond `capacity`.

    `tokenizer` is a path that every worker can read.
    """
    arrow_batches(docs.sparkSession, 2000)
    end = np.asarray([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    def cut(batches):
        ids_of = chunk_ids(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for doc, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = ids_of(value.as_py()) + end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - start)
                    rows.append((doc, k, start, length, ids[4 * start : 4 * (start + length)]))
                size += len(ids)
                if size > 1 << 24:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    source = docs.select(F.col("doc_id").cast("long"), text_of(text).cast("binary").alias("t"))
    return source.mapInArrow(cut, f"doc_id long, {PIECES}")


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item: longest first, into the fullest bin that has room.

    Bins of equal room are kept in one list; a bit set of the rooms in use
    finds the least sufficient one.
    """
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    in_use, count = 0, 0
    for item in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[item])
        fits = in_use >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            at = rooms[room].pop()
            if not rooms[room]:
                in_use ^= 1 << room
        else:
            room, at, count = capacity, count, count + 1
        bins[item], offsets[item] = at, capacity - room
        left = room - n
        if left:
            if not rooms[left]:
                in_use |= 1 << left
            rooms[left].append(at)
    return bins, offsets


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs; counts[n] items have length n.

    The largest of the volume bound and three families of dual-feasible
    functions, in whole numbers so that no rounding can lift a bound.
    """
    n = np.arange(capacity + 1)
    best = math.ceil(int((counts * n).sum()) / capacity)
    # large items count whole, small ones nothing, the middle its volume
    for e in range(1, capacity // 2 + 1):
        big = int(counts[capacity - e + 1 :].sum())
        middle = int((counts[e : capacity - e + 1] * n[e : capacity - e + 1]).sum())
        best = max(best, big + math.ceil(middle / capacity))
    # staircases: k steps, exact multiples keep their share
    for k in range(1, 21):
        exact = (n * (k + 1)) % capacity == 0
        value = np.where(exact, n * k, (n * (k + 1) // capacity) * capacity)
        best = max(best, math.ceil(int((counts * value).sum()) / (capacity * k)))
    # items above half leave room for whole multiples of e
    for e in sorted({capacity // d for d in range(2, 65)} - {0}):
        q = capacity // e
        value = np.where(n * 2 > capacity, q - (capacity - n) // e, np.where(n >= e, 1, 0))
        best = max(best, math.ceil(int((counts * value).sum()) / q))
    return best


def pack(items: DataFrame, length: str = "length", capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = 6) -> DataFrame:
    """Add sequence_id and offset: items of 1 to `capacity` share as few sequences as found.

    Columns of the items that have these names are replaced.
    """
    names = [c for c in items.columns if c not in ("sequence_id", "offset", "part", "gap", "fill")]
    pool = stored(items.select(*names))
    spark = items.sparkSession
    left = pool.count()
    histogram = pool.groupBy(length).count().collect()  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for row in histogram:
        counts[row[0]] = row[1]
    target = lower_bound(counts, capacity)
    settled, used, last_gap = [], 0, None
    for turn in range(rounds):
        parts = max(1, math.ceil(left / part_rows))
        packed = stored(_pack_parts(pool, names, length, capacity, parts, turn))
        sequences = packed.agg(F.countDistinct("sequence_id")).first()[0]
        gap = used + sequences - target
        if gap <= 0 or parts == 1 or turn == rounds - 1 or gap == last_gap:
            settled.append(packed)
            break
        # parts with a gap: more sequences than their own bound, or their last, half-empty ones
        loose = (F.col("fill") < capacity - capacity // 16) | (F.col("gap") > 0) & (F.col("fill") < capacity)
        settled.append(packed.where(~loose))
        used += packed.where(~loose).agg(F.countDistinct("sequence_id")).first()[0]
        pool = packed.where(loose).select(*names)
        left, last_gap = pool.count(), gap
        if not left:
            break
    out = functools.reduce(DataFrame.union, settled) if settled else spark.createDataFrame([], pool.schema)
    return out.select(*names, "sequence_id", "offset")


def _pack_parts(pool: DataFrame, names: list[str], length: str, capacity: int, parts: int, turn: int) -> DataFrame:
    """Best-fit decreasing in each part; `gap` is what it uses beyond its certified bound."""
    dealt = pool.select(*names, F.pmod(F.monotonically_increasing_id(), F.lit(parts)).alias("part"))
    added = [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset", "fill", "gap")]
    schema = T.StructType([*dealt.schema.fields, *added])

    def one(table: pa.Table) -> pa.Table:
        lengths = table.column(length).to_numpy().astype(np.int64)
        bins, offsets = best_fit_decreasing(lengths, capacity)
        gap = int(bins.max()) + 1 - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        number = (turn << 56) + (table.column("part")[0].as_py() << 24) + bins
        fill = np.bincount(bins, lengths).astype(np.int64)[bins]
        for name, values in (("sequence_id", number), ("offset", offsets), ("fill", fill), ("gap", np.full(len(bins), gap))):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    return dealt.groupBy("part").applyInArrow(one, schema)
