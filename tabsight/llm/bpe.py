"""Byte-level BPE: vectorised pre-tokenisation, cached merging, decoding by offsets.

Texts are cut as `'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?O+|\\s+(?!\\S)|\\s+` cuts
them (L letters, N numbers, O the rest that is not white space), without a
regular expression. Every code point gets a class; a class, with what follows
it, is a function from the state before the code point to the state after it.
The functions reachable by composition are few, so composing two of them is a
table lookup, and an associative scan over blocks of the text gives the state
at every code point, and with it every boundary, for many texts at once. The
slices between boundaries feed a cache of merged ids.

Defined cases: null and empty texts have no ids; repeated rows are encoded
alike; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from .common import arrow_batches, text_of

CACHE = 500_000  # merged slices that a worker keeps
BLOCK = 64  # code points that a block of the scan covers
CHUNK = 1 << 20  # bytes of text scanned at once, or one longer text

# Classes of code points, then what the neighbours make of them.
OTHER, LETTER, NUMBER, SPACE, BLANK = range(5)  # BLANK: white space that is not \x20
QUOTE1, QUOTE2, JOIN, LAST, INNER = range(5, 10)
SYMBOLS = 10
# States after a code point.
FREE, IN_LETTERS, IN_NUMBERS, IN_OTHER, JOINING, IN_BLANKS, ONE_MORE, TWO_MORE = range(8)
STATES = 8


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a code point, and whether a slice begins at it."""
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return FREE, False
    if symbol in (QUOTE1, QUOTE2):
        if state in (JOINING, IN_OTHER):
            return IN_OTHER, False  # taken by what began before it
        return (ONE_MORE if symbol == QUOTE1 else TWO_MORE), True
    if symbol in (LETTER, NUMBER, OTHER):
        inside = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}[symbol]
        return inside, state not in (JOINING, inside)
    if symbol == INNER:
        return IN_BLANKS, state != IN_BLANKS
    return (JOINING if symbol == JOIN else FREE), True  # the last of a run of white space


@functools.lru_cache(maxsize=1)
def transitions() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(composition, image, next state, begins): functions 0..SYMBOLS-1 are the symbols' own,
    the next SYMBOLS ones start a text; composition[f, g] is f, then g; image[f, s] the state it leads to."""
    steps = np.array([[_step(s, c)[0] for s in range(STATES)] for c in range(SYMBOLS)], np.uint8)
    begins = np.array([[_step(s, c)[1] for s in range(STATES)] for c in range(SYMBOLS)])
    functions = [tuple(row) for row in steps] + [(row[FREE],) * STATES for row in steps]
    functions.append(tuple(range(STATES)))
    number: dict[tuple, int] = {}
    for i, f in enumerate(functions):
        number.setdefault(f, i)
    table: dict[tuple[int, int], int] = {}
    done = 0
    while done < len(functions):  # close under composition
        for i in range(len(functions)):
            for j in range(len(functions)):
                if (i, j) not in table:
                    f = tuple(functions[j][s] for s in functions[i])
                    if f not in number:
                        number[f] = len(functions)
                        functions.append(f)
                    table[i, j] = number[f]
        done = len(functions) if all((i, j) in table for i in range(len(functions)) for j in range(len(functions))) else 0
    composition = np.zeros((len(functions), len(functions)), np.uint16)
    for (i, j), k in table.items():
        composition[i, j] = k
    return composition, np.array(functions, np.uint8), steps, begins


@functools.lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """Class of every code point, by the character properties that the tokenizer's library knows."""
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    text = "".join(points)
    table = np.full(0x110000, OTHER, np.uint8)
    single = {bytes([b]): b for b in range(256)}
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", BLANK)):
        coder = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        held = bytes(coder.encode_ordinary(text)).decode()
        table[np.frombuffer(held.encode("utf-32-le"), np.uint32)] = kind
    table[0x20] = SPACE
    return table


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Places where a slice begins in the code points of texts one after the other; `firsts` are the texts' own."""
    n = len(points)
    kind = classes()[points]
    ends = np.zeros(n, bool)  # last code point of a text
    ends[firsts[1:] - 1] = True
    ends[-1] = True
    after = np.empty(n, np.uint8)
    after[:-1] = kind[1:]
    after[ends] = BLANK  # white space at the end is all one run
    blank = (kind == SPACE) | (kind == BLANK)
    symbol = kind.copy()
    run_on = (after == SPACE) | (after == BLANK)
    symbol[blank & run_on] = INNER
    symbol[blank & ~run_on] = LAST
    symbol[(kind == SPACE) & ~run_on] = JOIN
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        text = np.searchsorted(firsts, quotes, "right")
        stop = np.append(firsts, n)[text]  # end of the text that holds the quote
        one = points[np.minimum(quotes + 1, n - 1)] * (quotes + 1 < stop)
        two = points[np.minimum(quotes + 2, n - 1)] * (quotes + 2 < stop)
        symbol[quotes[np.isin(one, [ord(c) for c in "stmd"])]] = QUOTE1
        pair = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        symbol[quotes[pair]] = QUOTE2

    composition, image, steps, begins = transitions()
    width = len(image)
    flat, identity = composition.ravel(), SYMBOLS * 2
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, identity, np.intp)
    padded[:n] = symbol
    padded[firsts] += SYMBOLS  # a text begins anew
    columns = np.ascontiguousarray(padded.reshape(rows, BLOCK).T)
    whole = columns[0].copy()
    for j in range(1, BLOCK):  # each block's function
        whole = flat[whole * width + columns[j]].astype(np.intp)
    shift = 1
    while shift < rows:  # associative scan over the blocks
        whole[shift:] = flat[whole[:-shift] * width + whole[shift:]]
        shift *= 2
    state = np.empty(rows, np.intp)
    state[0] = FREE
    state[1:] = image[whole[:-1], FREE]
    plain = np.zeros((BLOCK, rows), bool)
    step_flat, begin_flat = np.append(steps.ravel(), np.arange(STATES, dtype=np.uint8)), np.append(begins.ravel(), np.zeros(STATES, bool))
    for j in range(BLOCK):  # each code point's state
        c = columns[j]
        starts = (c >= SYMBOLS) & (c < identity)
        state[starts] = FREE
        at = np.where(starts, c - SYMBOLS, np.minimum(c, SYMBOLS)) * STATES + state
        plain[j] = begin_flat[at]
        state = step_flat[at].astype(np.intp)
    return np.flatnonzero(plain.T.ravel()[:n])


NEVER = 1 << 40
LONG = 64  # bytes from which a heap finds the next pair


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a slice: the adjacent pair of lowest rank merges first, the leftmost of equals."""
    if piece in ranks:
        return [ranks[piece]]
    if len(piece) >= LONG:
        return _merge_long(piece, ranks)
    rank = ranks.get
    parts = [piece[i : i + 1] for i in range(len(piece))]
    pairs = [rank(piece[i : i + 2], NEVER) for i in range(len(piece) - 1)]
    while pairs:
        least = min(pairs)
        if least == NEVER:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = rank(parts[i] + parts[i + 1], NEVER)
        if i:
            pairs[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
    return [ranks[p] for p in parts]


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    n = len(piece)
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    right = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, length = heapq.heappop(heap)
        if parts[i] is None or (j := right[i]) == n or len(parts[i]) + len(parts[j]) != length:
            continue  # one of the two has merged since
        parts[i] += parts[j]
        parts[j] = None
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
            joined = parts[i] + parts[right[i]]
            if (r := ranks.get(joined)) is not None:
                heapq.heappush(heap, (r, i, len(joined)))
        if left[i] >= 0:
            joined = parts[left[i]] + parts[i]
            if (r := ranks.get(joined)) is not None:
                heapq.heappush(heap, (r, left[i], len(joined)))
    return [ranks[p] for p in parts if p is not None]


class Coder:
    """Encodes and decodes many texts at once with one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, i in self.ranks.items():
            self.pieces[i] = piece
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.known: dict[bytes, bytes] = {}

    def ids_of(self, slices: list[bytes]) -> list[bytes]:
        known = self.known
        missing = set(slices).difference(known)
        if missing:
            if len(known) + len(missing) > CACHE:
                known = self.known = {}
                missing = set(slices)
            for s in missing:
                known[s] = np.asarray(merge(s, self.ranks), "<u4").tobytes()
        return list(map(known.__getitem__, slices))

    def encode(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids, offsets) of each text: little-endian uint32 ids, and the byte at which each begins as uint32."""
        whole = b"".join(texts)
        if not whole:
            return [(b"", b"")] * len(texts)
        points = np.frombuffer(whole.decode().encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(lengths)
        if len(points) == len(whole):
            byte_at = None
            firsts = (ends - lengths)[lengths > 0]
        else:
            width = 1 + (points >= 0x80) + (points >= 0x800).astype(np.int64) + (points >= 0x10000)
            byte_at = np.cumsum(width) - width
            firsts = np.searchsorted(byte_at, (ends - lengths)[lengths > 0])
        at = boundaries(points, firsts)
        if byte_at is not None:
            at = byte_at[at]
        cuts = at.tolist()
        slices = [whole[a:b] for a, b in zip(cuts, cuts[1:] + [len(whole)])]
        coded = self.ids_of(slices)
        ids = b"".join(coded)
        tokens = np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)))  # bytes of ids up to each slice
        # texts end where slices do
        upto = np.append(0, tokens)[np.searchsorted(at, ends)]
        start = np.cumsum(self.sizes[np.frombuffer(ids, "<u4")])
        start -= self.sizes[np.frombuffer(ids, "<u4")]
        out, before = [], 0
        for k, end in enumerate(upto.tolist()):
            own = start[before // 4 : end // 4] - (ends[k] - lengths[k])
            out.append((ids[before:end], own.astype("<u4").tobytes()))
            before = end
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    return Coder(path)


def _chunks(column: pa.Array) -> Iterator[list[bytes]]:
    held, size = [], 0
    for value in column:
        held.append(value.as_py())
        size += len(held[-1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, ranks: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """(doc_id, ids, offsets[, decoded]): ids and the byte offset of each, little-endian uint32.

    `ranks` is a path that every worker can read. With `decoded`, the ids are
    decoded in the same pass.
    """
    arrow_batches(docs.sparkSession, 2000)
    fields = [("doc_id", pa.int64()), ("ids", pa.binary()), ("offsets", pa.binary())] + [("decoded", pa.binary())] * decoded

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks)
        for batch in batches:
            at = 0
            for texts in _chunks(batch.column(1)):
                pairs = own.encode(texts)
                columns = [batch.column(0).slice(at, len(texts)), pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())]
                if decoded:
                    columns.append(pa.array([own.decode(p[0]) for p in pairs], pa.binary()))
                yield pa.record_batch(columns, schema=pa.schema(fields))
                at += len(texts)

    source = docs.select(F.col("doc_id").cast("long"), text_of(text).cast("binary").alias("t"))
    return source.mapInArrow(code, "doc_id long, ids binary, offsets binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, ranks: str, first: int = 0, last: int | None = None) -> DataFrame:
    """(doc_id, start, decoded): the bytes of ids first..last-1 and where they begin in the text, null beyond its end."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("decoded", pa.binary())])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(ranks)
        for batch in batches:
            starts, texts = [], []
            for ids, offsets in zip(batch.column(1), batch.column(2)):
                part = ids.as_py()[4 * first : None if last is None else 4 * last]
                place = np.frombuffer(offsets.as_py(), "<u4")
                starts.append(int(place[first]) if first < len(place) else None)
                texts.append(own.decode(part))
            yield pa.record_batch([batch.column(0), pa.array(starts, pa.int64()), pa.array(texts, pa.binary())], schema=schema)

    return encoded.select(F.col("doc_id").cast("long"), "ids", "offsets").mapInArrow(back, "doc_id long, start long, decoded binary")
