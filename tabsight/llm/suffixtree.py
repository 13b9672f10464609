"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are lower-cased words and one end per text. The root is the smoothed
word distribution of the training texts. A context is a run of words seen at
least LEAST times in them, as are the continuations it keeps, so the tree grows
with the corpus. A context is retained if its next-symbol distribution diverges
from that of its longest proper suffix by more than its description costs;
other contexts act as their suffix. Counts are discounted, and the mass set
free goes to all other symbols in the proportions of the suffix, so every
distribution adds up to one. A token is scored by the longest suffix of the
words before it that the tree holds.

Contexts that share their last word share their suffixes, so one exchange of
positions by last word before them lets a task count, test and smooth every
context that ends there and score its positions; only sums per text leave it.
Texts go as blocks of word ranks: a block lists its own words, Spark counts and
ranks the lists, and ranks come back to the blocks. A last word with more
positions than a part should hold is hot: its counts are summed by Spark, and its
positions are dealt by the word before, again so if that pair is hot as well.

With `p_min` the least count is that share of the training tokens. No level
then holds more than 1 / p_min contexts or continuations, whatever the corpus
size, and the tree is broadcast; words below p_min are joined by word.

Defined cases: null and empty texts are one end token; a null doc_id counts as
the empty text in the training split; repeated rows are scored alike; other
columns are ignored; without training texts every token has probability one
half over one half, and an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import arrow_batches, discard, shared_folder, stored, text_of

LEAST = 2  # times that a context or a continuation is seen in the training texts
PART = 600_000  # positions from which a context is hot; a part holds about two thirds of it
HOT_SHARE = 1e-6  # of all positions, that a hot context holds at least: there are at most a million of a level
BLOCK = 8 << 20  # bytes of text in a block
BITS = 34  # of a word's rank; as many words can differ, and 2 ** 29 contexts lie in a part
P_MIN = 1e-5
DEPTH = 2  # words in the longest context
DISCOUNT = 0.5
HELD = 400_000  # distinct words that a worker counts before it hands them on
KEYS = 2_000_000  # positions that a worker counts before it hands them on
START, END, FIRST = 0, 1, 2  # symbols before and after a text, of the most frequent word
LONGEST = 64  # bytes; longer words go by their digest, which starts with a space as no word does


def word_key(word: bytes) -> bytes:
    return word if len(word) <= LONGEST else b" " + hashlib.sha256(word).digest()


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # bytes: A-Z only, and exactly the ASCII white space


class Ids(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


@dataclass
class Tree:
    """grams[k]: sorted keys of the frequent runs of k + 1 symbols, as (run without its last) * (heads + 1) + last."""

    ids: Ids
    total: int
    distinct: int
    log_base: np.ndarray  # of the heads, then of the end
    least: int
    grams: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    ratio: list[np.ndarray] = field(default_factory=list)  # log10 p(last | run before) - log10 of the root's, for grams[k]
    spread: list[np.ndarray] = field(default_factory=list)  # log10 of the factor for symbols that a context doesn't keep
    retained: list[np.ndarray] = field(default_factory=list)

    @property
    def end(self) -> int:
        return len(self.log_base) - 1

    def log_of(self, count: np.ndarray | float) -> np.ndarray:
        return np.log10((np.asarray(count, float) + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def runs(self, symbols: np.ndarray) -> list[np.ndarray]:
        """At each position, the number of the frequent run of 1, 2, ... symbols that ends there, or -1."""
        out = [symbols]
        for keys in self.grams:
            out.append(find(keys, self.keys(out[-1], symbols)))
        return out

    def keys(self, runs: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        before = np.full(len(symbols), -1, np.int64)
        before[1:] = runs[:-1]
        before[1:][symbols[:-1] == self.end] = -1
        return np.where((before >= 0) & (symbols >= 0), before * (self.end + 1) + symbols, -1)

    def ratios(self, symbols: np.ndarray) -> np.ndarray:
        """log10 of how much likelier each symbol is than by the root."""
        runs = self.runs(symbols)
        out, open_ = np.zeros(len(symbols)), np.ones(len(symbols), bool)
        for k in range(len(self.grams), 0, -1):  # the longest context first
            context = np.full(len(symbols), -1, np.int64)
            context[1:] = runs[k - 1][:-1]
            context[1:][symbols[:-1] == self.end] = -1
            hit = open_ & (runs[k] >= 0)
            out[hit] += self.ratio[k - 1][runs[k][hit]]
            open_ &= ~hit
            miss = open_ & (context >= 0)
            out[miss] += self.spread[k - 1][context[miss]]
        return out


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def symbols_of(texts: list[bytes], tree: Tree) -> np.ndarray:
    parts = []
    for text in texts:
        words = words_of(text)
        one = np.empty(len(words) + 1, np.int64)
        one[:-1] = np.fromiter(map(tree.ids.__getitem__, words), np.int64, len(words))
        one[-1] = tree.end
        parts.append(one)
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def training(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, held_out, t): the split, by crc32 of the doc_id as text."""
    t = text_of(text)
    key = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64(t).alias("text_hash"), (key % 5 == 1).alias("held_out"), t.cast("binary").alias("t"))


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts in column `t`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                held.update(words_of(text.as_py()))
                if len(held) > HELD:
                    yield _counted(held)
                    held = Counter()
        if held:
            yield _counted(held)

    return texts.select("t").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _counted(held: Counter) -> pa.RecordBatch:
    words = pa.array([word_key(w) for w in held], pa.binary())
    return pa.record_batch([words, pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def run_counts(texts: DataFrame, tree: Tree) -> DataFrame:
    """(key, n): how often each frequent run goes on with each frequent symbol; runs with a rare suffix are left out."""
    held = texts.sparkSession.sparkContext.broadcast(tree)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, parts, size = held.value, [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                symbols = symbols_of([x.as_py() for x in batch.column(0).slice(at, 64)], own)
                runs = own.runs(symbols)
                keys = own.keys(runs[-1], symbols)
                keys = keys[(keys >= 0) & (runs[-1] >= 0)]
                parts.append(keys)
                size += len(keys)
                if size > KEYS:
                    yield _unique(parts)
                    parts, size = [], 0
        if size:
            yield _unique(parts)

    return texts.select("t").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _unique(parts: list[np.ndarray]) -> pa.RecordBatch:
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    return pa.record_batch([pa.array(keys), pa.array(counts, pa.int64())], names=["key", "n"])


def fit(texts: DataFrame, counts: DataFrame, p_min: float = P_MIN, depth: int = DEPTH) -> Tree:
    """The tree of the texts, given their word counts. What reaches the driver is bounded by p_min alone."""
    n_texts = texts.count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    total = words + n_texts
    least = max(2, math.ceil(p_min * total))
    heads = sorted((bytes(r[0]), r[1]) for r in counts.where(F.col("n") >= least).collect())
    tree = Tree(Ids((w, i) for i, (w, _) in enumerate(heads)), total, distinct + (n_texts > 0), np.empty(0), least)
    own = np.array([n for _, n in heads] + [n_texts], np.int64)
    tree.log_base = tree.log_of(own)
    tree.counts.append(own)
    for _ in range(depth):
        found = run_counts(texts, tree).where(F.col("n") >= least).orderBy("key").toPandas()
        _grow(tree, found["key"].to_numpy(np.int64), found["n"].to_numpy(np.int64))
        if not len(found):
            break
    return tree


def _grow(tree: Tree, keys: np.ndarray, counts: np.ndarray) -> None:
    """Add a level: contexts are the runs of the level before, `keys` their kept continuations."""
    k = len(tree.grams)
    width = tree.end + 1
    context, symbol = keys // width, keys % width
    n_context = tree.counts[k][context]
    own = np.log10((counts - DISCOUNT) / n_context) - tree.log_base[symbol]
    # the same continuation at the suffix
    if k == 0:
        suffix = np.zeros(len(keys))
    else:
        suffix = tree.ratio[k - 1][find(tree.grams[k - 1], _suffix(tree, k, context) * width + symbol)]
    contexts = len(tree.counts[k])
    kept = np.bincount(context, (counts - DISCOUNT) / n_context, contexts)
    kept_suffix = np.bincount(context, 10.0 ** (suffix + tree.log_base[symbol]), contexts)
    edges, seen = np.bincount(context, minlength=contexts), np.bincount(context, counts, contexts)
    some = edges > 0
    spread = np.zeros(contexts)
    spread[some] = np.log10(np.maximum(1 - kept[some], 1e-300) / np.maximum(1 - kept_suffix[some], 1e-12))
    gain = (np.bincount(context, counts * (own - suffix), contexts) + (tree.counts[k] - seen) * spread) * math.log(10)
    retained = some & (gain > 0.5 * (edges + 1) * np.log(np.maximum(tree.counts[k], 2)))
    tree.spread.append(np.where(retained, spread, 0.0))
    tree.ratio.append(np.where(retained[context], own, suffix))
    tree.retained.append(retained)
    tree.grams.append(keys)
    tree.counts.append(counts)


def _suffix(tree: Tree, k: int, runs: np.ndarray) -> np.ndarray:
    """Number, among the runs one symbol shorter, of each run of k + 1 symbols without its first."""
    width = tree.end + 1
    key = tree.grams[k - 1][runs]
    if k == 1:
        return key % width
    return find(tree.grams[k - 2], _suffix(tree, k - 1, key // width) * width + key % width)


def score(texts: DataFrame, counts: DataFrame, tree: Tree) -> DataFrame:
    """(doc_id, text_hash, held_out, n_tokens, n_known, base_score, score) of each text."""
    held = texts.sparkSession.sparkContext.broadcast(tree)
    schema = "doc_id long, text_hash long, held_out boolean, n_tokens long, head_known long, head_score double, ratio double"

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            rows = []
            for at in range(0, batch.num_rows, 64):
                values = [x.as_py() for x in batch.column(3).slice(at, 64)]
                symbols = symbols_of(values, own)
                ends = np.flatnonzero(symbols == own.end) + 1
                firsts = np.append(0, ends[:-1])
                known = symbols >= 0
                base = np.where(known, own.log_base[symbols], 0.0)
                known[ends - 1] = own.counts[0][own.end] > 0
                rows.append([ends - firsts, *[np.add.reduceat(x, firsts) for x in (known.astype(np.int64), base, own.ratios(symbols))]])
            added = [pa.array(np.concatenate(x)) for x in zip(*rows)]
            yield pa.record_batch([*batch.columns[:3], *added], names=["doc_id", "text_hash", "held_out", "n_tokens", "head_known", "head_score", "ratio"])

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = held.value.ids
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                docs, hashes, words, times, marks = [], [], [], [], []
                part = batch.slice(at, 256)
                for doc, text_hash, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3)):
                    rare = Counter(w for w in words_of(text.as_py()) if w not in ids)
                    words.extend(map(word_key, rare))
                    times.extend(rare.values())
                    docs.extend([doc] * len(rare))
                    hashes.extend([text_hash] * len(rare))
                    marks.extend([1] + [0] * (len(rare) - 1) if rare else [])
                types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32())
                yield pa.record_batch([pa.array(c, t) for c, t in zip((docs, hashes, words, times, marks), types)], names=["doc_id", "text_hash", "word", "times", "mark"])

    by_head = texts.mapInArrow(heads, schema)
    rare = texts.mapInArrow(tails, "doc_id long, text_hash long, word binary, times int, mark int")
    c = F.coalesce("n", F.lit(0))
    log_p = F.log10((c + 0.5) / F.lit(tree.total + 0.5 * (tree.distinct + 1)))
    tail = (
        rare.join(counts.where(F.col("n") < tree.least), "word", "left")
        .groupBy("doc_id", "text_hash")
        .agg(F.sum(F.col("times") * log_p).alias("s"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("k"), F.sum("mark").alias("copies"))
        .select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), (F.col("s") / F.col("copies")).alias("s"), F.expr("k div copies").alias("k"))
    )
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_hash") == F.col("_hash"))
    base = F.col("head_score") + F.coalesce("s", F.lit(0.0))
    return by_head.join(tail, same, "left").select(
        "doc_id",
        "text_hash",
        "held_out",
        "n_tokens",
        (F.col("head_known") + F.coalesce("k", F.lit(0))).alias("n_known"),
        base.alias("base_score"),
        (base + F.col("ratio")).alias("score"),
    )


class Local(dict):
    """Numbers of the words of a block, in the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self) + 1  # 0 is the end
        return value


@dataclass
class Hot:
    """Contexts of one level with more positions than a part should hold.

    keys: sorted, (number of the context one word shorter) << BITS | oldest word; parts: first part and how many.
    """

    keys: np.ndarray
    parent: np.ndarray
    seen: np.ndarray  # positions, then those that no longer hot context holds
    default: np.ndarray | None = None  # ratio of the symbols that no table row names
    first: np.ndarray | None = None
    parts: np.ndarray | None = None


@dataclass
class Table:
    """What all tasks know: totals, the counts of words by rank, and the hot contexts level by level."""

    total: int
    distinct: int
    least: int
    depth: int
    ends: int  # training texts
    starts: np.ndarray  # first rank of each different count, and the count
    counts: np.ndarray
    limit: int = PART  # positions from which a context is hot
    cold: int = 1  # parts of the contexts whose last word isn't hot
    hot: list[Hot] = field(default_factory=list)

    def count_of(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.starts):
            return np.where(symbols == END, self.ends, 0)
        at = np.searchsorted(self.starts, symbols - FIRST, "right") - 1
        return np.where(symbols == END, self.ends, np.where(symbols >= FIRST, self.counts[np.maximum(at, 0)], 0))

    def base(self, symbols: np.ndarray) -> np.ndarray:
        return np.log10((self.count_of(symbols) + 0.5) / (self.total + 0.5 * (self.distinct + 1)))

    def hot_levels(self, words: list[np.ndarray]) -> list[np.ndarray]:
        """For each level, the number of the hot context before each position, or -1; words[0] is the last word before."""
        out: list[np.ndarray] = []
        for k, hot in enumerate(self.hot):
            before = out[-1] if out else np.zeros(len(words[0]), np.int64)
            out.append(np.where(before >= 0, find(hot.keys, (before << BITS) | words[k]), -1))
        return out

    def parts_of(self, words: list[np.ndarray], symbols: np.ndarray) -> np.ndarray:
        """The part that counts and scores each position: all positions of a context that isn't hot lie in one."""
        part = words[0] % self.cold
        for k, number in enumerate(self.hot_levels(words)):
            at = np.flatnonzero(number >= 0)
            split = (words[k + 1] if k + 1 < self.depth else symbols)[at]
            part[at] = self.hot[k].first[number[at]] + split % self.hot[k].parts[number[at]]
        return part

    def level_of(self, part: int) -> tuple[int, float]:
        """Words of the hot context that a part belongs to, and its default ratio."""
        for k, hot in enumerate(self.hot):
            if len(hot.first) and hot.first[0] <= part < hot.first[-1] + hot.parts[-1]:
                return k + 1, float(hot.default[np.searchsorted(hot.first, part, "right") - 1])
        return 0, 0.0


def pack(values: np.ndarray) -> bytes:
    """Numbers from 0 on, byte by byte of their places, compressed."""
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view("<i8").astype(np.int64, copy=False)


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each key among the different ones, and a position of each different one."""
    order = np.argsort(keys)
    new = np.empty(len(keys), bool)
    new[:1] = True
    in_order = keys[order]
    np.not_equal(in_order[1:], in_order[:-1], out=new[1:])
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return number, order[new]


def blocks_of(texts: DataFrame) -> DataFrame:
    """Texts in blocks of some 8 MB (or one longer text) as numbers of the block's own words, training texts first."""

    def block(number: int, rows: list[tuple[int | None, bool, bytes]]) -> pa.RecordBatch:
        rows.sort(key=lambda r: r[1])
        ids, parts, own = Local(), [], 0
        for doc, held, text in rows:
            words = words_of(text)
            one = np.zeros(len(words) + 1, np.int64)
            one[:-1] = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
            parts.append(one)
            own += 0 if held else len(one)
        tokens = np.concatenate(parts)
        n, m = (np.bincount(x, minlength=len(ids) + 1)[1:] for x in (tokens[:own], tokens))
        words = pa.StructArray.from_arrays([pa.array([word_key(w) for w in ids], pa.binary()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], ["word", "n", "m"])
        columns = {
            "block": pa.array([number], pa.int64()),
            "docs": pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
            "trained": pa.array([sum(not r[1] for r in rows)], pa.int64()),
            "sizes": pa.array([pack(np.array([len(x) for x in parts], np.int64))], pa.binary()),
            "tokens": pa.array([pack(tokens)], pa.binary()),
            "words": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words),
        }
        return pa.record_batch(list(columns.values()), names=list(columns))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, rows, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for doc, held, text in zip(*(batch.column(k) for k in (0, 1, 2))):
                rows.append((doc.as_py(), held.as_py(), text.as_py()))
                size += len(rows[-1][2]) + 8
                if size > BLOCK:
                    yield block(number, rows)
                    number, rows, size = number + 1, [], 0
        if rows:
            yield block(number, rows)

    schema = "block long, docs array<long>, trained long, sizes binary, tokens binary, words array<struct<word: binary, n: long, m: long>>"
    return texts.select("doc_id", "held_out", "t").mapInArrow(emit, schema)


def with_ranks(texts: DataFrame, least: int, depth: int, part: int) -> tuple[DataFrame, Table]:
    """Blocks of the texts with the rank of each of their words by count, and the table of totals.

    What reaches the driver: a number per slice of the word list, one row per
    different count (fewer than the root of twice all tokens, as different
    counts add up to no more), and the words with more positions than a part.
    """
    spark, found = texts.sparkSession, blocks_of(texts)
    places = [shared_folder(spark, name) for name in ("blocks", "words")]
    found.write.parquet(places[0])
    blocks = spark.read.schema(found.schema).parquet(places[0])
    listed = blocks.select("block", F.posexplode("words").alias("pos", "w")).select("block", "pos", "w.word", "w.n", "w.m")
    counts = listed.groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    order = [F.desc("n"), F.col("word")]
    in_order = counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    in_order.write.parquet(places[1])
    words = spark.read.schema(in_order.schema).parquet(places[1])
    slice_, place = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = words.groupBy(slice_.alias("slice")).agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("slice")
    before = [0, *np.cumsum(sizes["n"])[:-1].tolist()] if len(sizes) else []
    shifts = spark.createDataFrame([(int(a), int(b)) for a, b in zip(sizes["slice"], before)], "slice int, shift long")
    ranked = words.withColumn("slice", slice_.cast("int")).join(F.broadcast(shifts), "slice").select("word", "n", "m", (place + F.col("shift")).alias("rank"))
    by_count = ranked.groupBy("n").agg(F.min("rank").alias("rank"), F.count(F.lit(1)).alias("words")).toPandas().sort_values("rank")
    n, of = by_count["n"].to_numpy(np.int64), by_count["words"].to_numpy(np.int64)
    docs, ends = blocks.agg(F.coalesce(F.sum(F.size("docs")), F.lit(0)), F.coalesce(F.sum("trained"), F.lit(0))).first()
    table = Table(int((n * of).sum()) + ends, int(of[n > 0].sum()) + (ends > 0), least, depth, ends, by_count["rank"].to_numpy(np.int64), n)
    tokens = int(words.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]) + docs
    table.limit = max(part, math.ceil(HOT_SHARE * tokens))
    table.cold = max(1, math.ceil(1.5 * tokens / table.limit))
    often = ranked.where(F.col("m") >= table.limit).select("rank", "m").toPandas().sort_values("rank")
    if len(often):
        table.hot.append(Hot(often["rank"].to_numpy(np.int64) + FIRST, np.zeros(len(often), np.int64), often["m"].to_numpy(np.int64)))
    maps = listed.select("block", "pos", "word").join(ranked.select("word", "rank"), "word").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("pos", "rank"))).alias("ranks"))
    own = blocks.drop("words").join(maps.select("block", F.col("ranks.rank").alias("ranks")), "block", "left")
    ranked_blocks = stored(own)
    for place in places:
        discard(spark, place)
    return ranked_blocks, table


def positions_of(batch: pa.RecordBatch, row: int, table: Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """A block's tokens per text, symbols, the words before each (last first) and text numbers.

    Words seen less often than `least` are in no context and no continuation:
    they stand as START among the words before.
    """
    ranks = batch.column("ranks")[row].values
    ids = np.concatenate([[END], ranks.to_numpy().astype(np.int64) + FIRST if ranks is not None else np.empty(0, np.int64)])
    sizes = unpack(batch.column("sizes")[row].as_py())
    tokens = unpack(batch.column("tokens")[row].as_py())
    symbols, known = ids[tokens], np.where(table.count_of(ids) >= table.least, ids, START)[tokens]
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(tokens)) - (np.cumsum(sizes) - sizes)[text]
    before = []
    for k in range(1, table.depth + 1):
        one = np.full(len(tokens), START, np.int64)
        one[k:] = known[:-k] if k < len(tokens) else one[k:]
        one[inside < k] = START
        before.append(one)
    return sizes, symbols, before, text


def hot_contexts(ranked: DataFrame, table: Table) -> DataFrame | None:
    """Statistics of the hot contexts, level by level: (part, s, ratio) of their continuations, for each part that needs them.

    A hot context's counts are gathered block by block and summed by Spark; a
    row per hot context reaches the driver.
    """
    values: list[DataFrame] = []
    while table.hot and len(values) < table.depth and len(table.hot) > len(values):
        k = len(values)
        held = ranked.sparkSession.sparkContext.broadcast(table)

        def emit(batches: Iterator[pa.RecordBatch], k: int = k, held=held) -> Iterator[pa.RecordBatch]:
            own = held.value
            for batch in batches:
                for row in range(batch.num_rows):
                    _, symbols, before, text = positions_of(batch, row, own)
                    number = own.hot_levels(before)[k]
                    at = np.flatnonzero(number >= 0)
                    trained = text[at] < batch.column("trained")[row].as_py()
                    s = np.where(own.count_of(symbols[at]) >= own.least, symbols[at], START)
                    found = [(0, s)] if k + 1 == own.depth else [(0, s), (1, before[k + 1][at])]
                    for kind, other in found:
                        which, first = numbered((number[at] << BITS) | other)
                        n = np.bincount(which, trained if kind == 0 else None, minlength=len(first)).astype(np.int64)
                        c = own.count_of(other[first]) if kind == 0 else np.zeros(len(first), np.int64)
                        columns = [pa.array(np.full(len(first), kind), pa.int32()), pa.array(number[at][first]), pa.array(other[first]), pa.array(n), pa.array(c)]
                        yield pa.record_batch(columns, names=["kind", "h", "s", "n", "c"])

        sums = stored(ranked.mapInArrow(emit, "kind int, h long, s long, n long, c long").groupBy("kind", "h", "s").agg(F.sum("n").alias("n"), F.max("c").alias("c")))
        values.append(_hot_values(sums.where("kind = 0"), table, k, values))
        longer = sums.where((F.col("kind") == 1) & (F.col("s") != START) & (F.col("n") >= table.limit)).toPandas()
        if len(longer):
            keys = (longer["h"].to_numpy(np.int64) << BITS) | longer["s"].to_numpy(np.int64)
            order = np.argsort(keys)
            table.hot.append(Hot(keys[order], longer["h"].to_numpy(np.int64)[order], longer["n"].to_numpy(np.int64)[order]))
    return _dealt(ranked, table, values)


def _hot_values(edges: DataFrame, table: Table, k: int, values: list[DataFrame]) -> DataFrame:
    """(h, s, ratio) of the continuations that a hot context or its suffixes keep."""
    spark, hot = edges.sparkSession, table.hot[k]
    above = table.hot[k - 1].default[hot.parent] if k else np.zeros(len(hot.keys))
    small = [(i, int(p), float(d)) for i, (p, d) in enumerate(zip(hot.parent, above))]
    of = edges.groupBy("h").agg(F.sum("n").alias("of")).toPandas().set_index("h")["of"].reindex(range(len(hot.keys))).fillna(0).to_numpy(float)
    keeps = (F.col("n") >= table.least) & (F.col("s") != START)
    own = edges.join(F.broadcast(spark.createDataFrame(small, "h long, parent long, above double")), "h")  # one row a hot context
    if k:
        shorter = values[-1].select(F.col("h").alias("parent"), "s", F.col("ratio").alias("named"))
        own = own.join(shorter, ["parent", "s"], "left").where(keeps | F.col("named").isNotNull())
    else:
        own = own.where(keeps).withColumn("named", F.lit(None).cast("double"))
    base = F.log10((F.col("c") + 0.5) / F.lit(table.total + 0.5 * (table.distinct + 1)))
    own = own.withColumn("prev", F.coalesce("named", "above")).withColumn("base", base)
    gain = F.log10(F.col("n") - DISCOUNT) - F.col("base") - F.col("prev")
    sums = own.where(keeps).groupBy("h").agg(
        F.count(F.lit(1)).alias("edges"),
        F.sum("n").alias("seen"),
        F.sum(F.pow(F.lit(10.0), F.col("base") + F.col("prev"))).alias("kept_suffix"),
        F.sum(F.col("n") * gain).alias("own"),
    )
    found = sums.toPandas().set_index("h").reindex(range(len(hot.keys))).fillna(0)
    spread, retained = judged(of, *(found[c].to_numpy(float) for c in ("edges", "seen", "kept_suffix", "own")))
    hot.default = above + np.where(retained, spread, 0.0)
    small = [(i, bool(r), float(s), float(o)) for i, (r, s, o) in enumerate(zip(retained, spread, of))]
    told = own.join(F.broadcast(spark.createDataFrame(small, "h long, retained boolean, spread double, of double")), "h")
    ratio = F.when(~F.col("retained"), F.col("prev")).when(keeps, F.log10((F.col("n") - DISCOUNT) / F.col("of")) - F.col("base")).otherwise(F.col("spread") + F.col("prev"))
    return stored(told.where(F.col("named").isNotNull() | (F.col("retained") & keeps)).select("h", "s", ratio.alias("ratio")))


def judged(of: np.ndarray, edges: np.ndarray, seen: np.ndarray, kept_suffix: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of the factor for symbols that a context doesn't keep, and whether its divergence pays for its description."""
    size = np.maximum(of, 1)
    left = 1 - (seen - DISCOUNT * edges) / size
    spread = np.log10(np.maximum(left, 1e-300) / np.maximum(1 - kept_suffix, 1e-12))
    gain = (own - seen * np.log10(size) + (of - seen) * spread) * math.log(10)
    return spread, (edges > 0) & (gain > 0.5 * (edges + 1) * np.log(size))


def _dealt(ranked: DataFrame, table: Table, values: list[DataFrame]) -> DataFrame | None:
    """Give hot contexts their parts, and the rows of `values` to every part of their context."""
    start, out = table.cold, None
    for k, hot in enumerate(table.hot):
        rest = hot.seen.copy()
        if k + 1 < len(table.hot):
            np.subtract.at(rest, table.hot[k + 1].parent, table.hot[k + 1].seen)
        hot.parts = np.maximum(1, -(-rest * 3 // (2 * table.limit)))
        hot.first = start + np.cumsum(hot.parts) - hot.parts
        start += int(hot.parts.sum())
        small = ranked.sparkSession.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(zip(hot.first, hot.parts))], "h long, first long, parts long")
        rows = values[k].join(F.broadcast(small), "h")
        if k + 1 < table.depth:
            rows = rows.withColumn("part", F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)))
        else:
            rows = rows.withColumn("part", F.col("first") + F.col("s") % F.col("parts"))
        rows = rows.select("part", "s", "ratio")
        out = rows if out is None else out.union(rows)
    return out


def emitted(ranked: DataFrame, table: Table) -> DataFrame:
    """Per block: a row with its texts and their base scores (negative part), and a row of positions for each part."""
    held = ranked.sparkSession.sparkContext.broadcast(table)
    names = ["part", "block", "trained", "payload"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for batch in batches:
            for row in range(batch.num_rows):
                number, trained = batch.column("block")[row].as_py(), batch.column("trained")[row].as_py()
                sizes, symbols, before, text = positions_of(batch, row, own)
                firsts = np.cumsum(sizes) - sizes
                docs = pa.record_batch(
                    [
                        pa.array(batch.column("docs")[row].as_py(), pa.int64()),
                        pa.array(np.arange(len(sizes)) >= trained),
                        pa.array(sizes),
                        pa.array(np.add.reduceat((own.count_of(symbols) > 0).astype(np.int64), firsts)),
                        pa.array(np.add.reduceat(own.base(symbols), firsts)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score"],
                )
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, docs.schema) as writer:
                    writer.write_batch(docs)
                rows = [(-1 - number, sink.getvalue().to_pybytes())]
                at = np.flatnonzero(before[0] != START)
                words = [x[at] for x in before]
                s = np.where(own.count_of(symbols[at]) >= own.least, symbols[at], START)
                part = own.parts_of(words, s)
                order = ordered(part, words[0], s)
                cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(order)]):
                    one = order[a:b]
                    columns = [np.diff(words[0][one], prepend=0), s[one], text[at[one]], *(x[one] for x in words[1:])]
                    packed = [pack(x) for x in columns]
                    head = np.array([len(x) for x in packed], "<i4").tobytes()
                    rows.append((int(part[one[0]]), head + b"".join(packed)))
                for a in range(0, len(rows), 256):
                    some = rows[a : a + 256]
                    columns = [[r[0] for r in some], [number] * len(some), [trained] * len(some)]
                    yield pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), pa.array([r[1] for r in some], pa.binary())], names=names)

    return ranked.mapInArrow(emit, "part long, block long, trained long, payload binary")


def ordered(part: np.ndarray, word: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Positions by part, last word before and symbol."""
    bits = [int(x.max(initial=0)).bit_length() for x in (part, word, symbol)]
    if sum(bits) < 63:
        return np.argsort((part << (bits[1] + bits[2])) | (word << bits[2]) | symbol)
    return np.lexsort((symbol, word, part))


def ratios(table: Table, start: int, words: list[np.ndarray], symbols: np.ndarray, trained: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """log10 of how much likelier each position's symbol is than by the root, from the ratios by contexts of `start` words.

    The positions of every longer context are all here, so contexts are
    counted, tested and smoothed level by level on the spot.
    """
    active, group = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
    for k in range(start, table.depth):
        inside = words[k][active] != START
        active, group = active[inside], group[inside]
        context, _ = numbered((group << BITS) | words[k][active])
        of = np.bincount(context, trained[active])
        enough = of[context] >= table.least if len(of) else np.zeros(0, bool)
        active, group = active[enough], context[enough]
        if not len(active):
            break
        edge, first = numbered((group << BITS) | symbols[active])
        n = np.bincount(edge, trained[active])
        owner, symbol, before = group[first], symbols[active][first], ratio[active][first]
        kept = (n >= table.least) & (symbol != START)
        base = table.base(symbol)
        sums = [np.bincount(owner[kept], x, len(of)) for x in (None, n[kept], 10.0 ** (base + before)[kept], (n * (np.log10(np.maximum(n - DISCOUNT, DISCOUNT)) - base - before))[kept])]
        spread, retained = judged(of, *sums)
        own = np.where(kept, np.log10(np.maximum(n - DISCOUNT, DISCOUNT) / np.maximum(of[owner], 1)) - base, spread[owner] + before)
        ratio[active] = np.where(retained[owner], own, before)[edge]
    return ratio


def scored_parts(rows: DataFrame, table: Table) -> DataFrame:
    """(block, texts, sums, docs): per part and block, what the positions of each text add to its score."""
    held = rows.sparkSession.sparkContext.broadcast(table)
    schema = pa.schema([("block", pa.int64()), ("texts", pa.binary()), ("sums", pa.binary()), ("docs", pa.binary())])

    def one(t: pa.Table) -> pa.Table:
        own, part = held.value, t.column("part")[0].as_py()
        if part < 0:
            return pa.table([t.column("block"), pa.nulls(len(t), pa.binary()), pa.nulls(len(t), pa.binary()), t.column("payload")], schema=schema)
        named = t.filter(pc.is_null(t.column("block")))
        t = t.filter(pc.is_valid(t.column("block")))
        found = []
        for data, trained in zip(t.column("payload"), t.column("trained")):
            data, columns = data.as_py(), []
            ends = 4 * (own.depth + 2) + np.cumsum(np.frombuffer(data[: 4 * (own.depth + 2)], "<i4"))
            for a, b in zip([4 * (own.depth + 2), *ends[:-1]], ends):
                columns.append(unpack(data[a:b]))
            columns[0] = np.cumsum(columns[0])
            found.append([*columns, columns[2] < trained.as_py()])
        if not found:
            return schema.empty_table()
        sizes = [len(x[0]) for x in found]
        last, symbols, text, *more, trained = (np.concatenate(x) for x in zip(*found))
        del found
        start, default = own.level_of(part)
        ratio = np.full(len(symbols), default)
        if len(named):
            s, value = named.column("s").to_numpy(), named.column("ratio").to_numpy()
            order = np.argsort(s)
            at = find(s[order], symbols)
            ratio = np.where(at >= 0, value[order][at], default)
        ratio = ratios(own, start, [last, *more], symbols, trained, ratio)
        texts, sums, a = [], [], 0
        for size in sizes:
            total = np.bincount(text[a : a + size], ratio[a : a + size])
            changed = np.flatnonzero(total)
            texts.append(pack(np.diff(changed, prepend=0)))
            sums.append(zstandard.ZstdCompressor(level=1).compress(total[changed].tobytes()))
            a += size
        return pa.table([t.column("block"), pa.array(texts, pa.binary()), pa.array(sums, pa.binary()), pa.nulls(len(t), pa.binary())], schema=schema)

    return rows.groupBy("part").applyInArrow(one, "block long, texts binary, sums binary, docs binary")


def added_up(parts: DataFrame) -> DataFrame:
    """The texts of each block with their scores."""

    def one(t: pa.Table) -> pa.Table:
        docs = next(x for x in t.column("docs") if x.is_valid)
        rows = pa.ipc.open_stream(docs.as_py()).read_all()
        ratio = np.zeros(len(rows))
        for texts, sums in zip(t.column("texts"), t.column("sums")):
            if texts.is_valid:
                ratio[np.cumsum(unpack(texts.as_py()))] += np.frombuffer(zstandard.ZstdDecompressor().decompress(sums.as_py()))
        return rows.append_column("score", pa.array(rows.column("base_score").to_numpy() + ratio))

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    return parts.groupBy("block").applyInArrow(one, schema)


def score_table(texts: DataFrame, least: int = LEAST, depth: int = DEPTH, part: int = PART) -> tuple[DataFrame, Table]:
    """Scores of all texts by the tree of those that are not held out, with about `part` positions a part."""
    ranked, table = with_ranks(texts, least, depth, part)
    named = hot_contexts(ranked, table)
    rows = emitted(ranked, table).select("*", F.lit(None).cast("long").alias("s"), F.lit(None).cast("double").alias("ratio"))
    if named is not None:
        nothing = [F.lit(None).cast("long").alias("block"), F.lit(None).cast("long").alias("trained"), F.lit(None).cast("binary").alias("payload")]
        rows = rows.union(named.select("part", *nothing, "s", "ratio"))
    return added_up(scored_parts(rows, table)), table


def score_documents(docs: DataFrame, text: str = "text", p_min: float | None = None, depth: int = DEPTH, part: int = PART) -> tuple[DataFrame, Table | Tree]:
    """Scores of all documents by the tree of those that are not held out, and the tree."""
    arrow_batches(docs.sparkSession, 2000)
    texts = training(docs, text)
    if p_min is None:
        return score_table(texts, LEAST, depth, part)
    train = texts.where("not held_out")
    counts = stored(word_counts(train))
    tree = fit(train, counts, p_min, depth)
    return score(texts, counts, tree), tree
