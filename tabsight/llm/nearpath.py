"""Near-duplicate join on word shingles by chosen paths.

Each text becomes the set of its five-word shingles. Equal sets are one class;
class representatives are branched by trees: at every level a document follows
its minwise token for that tree and level, so two documents stay together with
the probability of their similarity. Nodes of few documents stop branching and
are compared exhaustively, several independent trees bring the recall to its
target, and every link is confirmed on the full sets.

The exhaustive comparison runs in two rounds, so that a node of many copies
costs no pair list: first each document against its node's smallest member,
then, only in nodes that still hold different components, the documents outside
the node's largest component against the members of other components. Nodes
that stay crowded at the last level are compared block against block.

Defined cases: a null text or one without words has an empty set and is linked
with nothing; fewer than five words are one shingle; repeated rows and equal
sets are one class; a null doc_id is not taken as component_id unless its class
has no other; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import arrow_batches, stored, text_of, whole_rows

SHINGLE = 5
PERCENT = 85  # link from 100 * intersection >= PERCENT * union
TREES = 16
DEPTH = 8
RECALL = 0.99  # of pairs that are just similar enough for a link
LEAF = 16  # members up to which a node is not branched further
BLOCK = 1024  # members of a crowded node that are compared with as many others in one task,
BLOCK_BYTES = 4 << 20  # and about the bytes of their texts
WORDS = 300_000  # word hashes that a worker keeps
EMPTY = np.empty(0, np.uint64)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = WordHashes()
_odd = np.random.default_rng(5).integers(0, 1 << 63, size=(2 * SHINGLE,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text (UTF-8)."""
    words = text.lower().split()  # bytes: A-Z only, and exactly the ASCII white space
    if not words:
        return EMPTY
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        mixed = sum(int(x) * int(m) for x, m in zip(h, _odd[SHINGLE:])) + len(h)
        return np.asarray([mixed & 0xFFFFFFFFFFFFFFFF], np.uint64)
    total = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        total += h[k : k + len(total)] * _odd[k]
    return np.unique(_mixed(total))


def signature(shingles: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Minwise token of the set for each seed, as 32 bits of its hash."""
    out = np.full(len(seeds), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        block = shingles[at : at + 4096, None] * seeds[None, :]
        np.minimum(out, (block ^ (block >> np.uint64(32))).min(axis=0), out=out)
    return _mixed(out).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, text: str = "text", trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, sig, sketch): node is the 128-bit digest of the shingle set, sketch the low bytes of sig."""
    seeds = np.random.default_rng(17).integers(0, 1 << 63, size=(trees * depth,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    arrow_batches(docs.sparkSession, 2000)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, sigs, low = [], [], [], []
            for value in batch.column(2):
                s = shingle_set(value.as_py())
                sizes.append(len(s))
                nodes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sigs.append(signature(s, seeds) if len(s) else np.zeros(len(seeds), np.int32))
                low.append(sigs[-1].astype(np.uint8).view("<i8"))
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * n), pa.array(np.concatenate([*x, x[0][:0]]) if x else np.empty(0, t))) for x, n, t in ((sigs, len(seeds), np.int32), (low, len(seeds) // 8, np.int64))]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), *lists],
                names=["doc_id", "text_hash", "n_shingles", "node", "sig", "sketch"],
            )
        _words.clear()  # a worker that goes on to other work gives its memory back

    t = text_of(text)
    source = docs.select(F.col("doc_id").cast("long"), F.xxhash64(t).alias("text_hash"), t.cast("binary").alias("t"))
    return source.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, node binary, sig array<int>, sketch array<bigint>")


def leaves(classes: DataFrame, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF) -> DataFrame:
    """(key, node): members of the nodes in which branching ended, with two or more members."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    rows = classes.select("node", tree.alias("tree"), "sig")
    path = F.slice("sig", F.col("tree") * depth + 1, F.lit(depth))
    rows = rows.select("node", path.alias("path"), F.xxhash64("tree", F.get("path", F.lit(0))).alias("key"))
    ended = []
    for level in range(1, depth + 1):
        rows = stored(rows)
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        grouped = stored(rows.join(sizes, "key"))
        last = level == depth
        ended.append(grouped.where(F.lit(True) if last else F.col("n") <= leaf).select("key", "node"))
        rows = grouped.where(F.col("n") > leaf).select("node", "path", F.xxhash64("key", F.get("path", F.lit(min(level, depth - 1)))).alias("key"))
        if last or not grouped.where(F.col("n") > leaf).limit(1).count():
            break
    out = ended[0]
    for part in ended[1:]:
        out = out.union(part)
    return out


def depth_of(percent: int, trees: int = TREES) -> int:
    """The greatest depth, up to DEPTH, at which pairs of just that similarity share a node of some tree with RECALL."""
    deep = [d for d in range(1, DEPTH + 1) if 1 - (1 - (percent / 100) ** d) ** trees >= RECALL]
    return max(deep, default=1)


def agreeing(a: Column, b: Column, size: int) -> Column:
    """In how many of their `size` bytes two sketches agree."""
    out = F.lit(size)
    for k in range(size // 8):
        x = F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))
        for bits in (4, 2, 1):  # the lowest bit of each byte becomes the union of its bits
            x = x.bitwiseOR(F.shiftrightunsigned(x, bits))
        out = out - F.bit_count(x.bitwiseAND(F.lit(0x0101010101010101)))
    return out


def least_agreeing(percent: int) -> int:
    """Bytes in which the sketches of similar sets agree, less four deviations."""
    n, p = TREES * depth_of(percent), percent / 100
    return int(n * p - 4 * (n * p * (1 - p)) ** 0.5)


def alike(a: Column, b: Column, percent: int = PERCENT) -> Column:
    """Whether two sketches agree often enough for a link."""
    return agreeing(a, b, TREES * depth_of(percent)) >= least_agreeing(percent)


def texts_of(nodes: DataFrame, docs: DataFrame, classes: DataFrame, text: str = "text") -> DataFrame:
    """(node, t): the text of one document of each class in `nodes`."""
    t = text_of(text)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(t).alias("text_hash"), t.alias("t"))
    wanted = nodes.join(classes.select("node", "doc_id", "text_hash"), "node")
    same_row = keyed["doc_id"].eqNullSafe(wanted["doc_id"]) & (keyed["text_hash"] == wanted["text_hash"])
    return keyed.join(wanted, same_row).select("node", F.col("t").cast("binary").alias("t"))


def confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    pairs = stored(pairs.distinct())
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = stored(texts_of(needed, docs, classes, text))
    left = pairs.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
    both = left.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").select("a", "b", "ta", "tb")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, EMPTY
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0), batch.column(2), batch.column(3)):
                if a != last:
                    last, held = a, shingle_set(ta.as_py())
                other = shingle_set(tb.as_py())
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(held) + len(other) - both) and both > 0)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))
        _words.clear()

    return both.mapInArrow(check, "a binary, b binary").distinct()


def block_links(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between members of different components in the same crowded node, found block against block.

    `members` has key, n (members of the node), node, label, sketch and t. A
    task holds two blocks of bounded rows and bytes and writes only links that join components it has not
    joined yet, so no list of pairs arises; each text is copied once a block,
    and most nodes are one block.
    """
    sizes = members.groupBy("key").agg(F.sum(F.octet_length("t").cast("long")).alias("bytes")).withColumnRenamed("key", "_key")
    members = members.join(sizes, F.col("key") == F.col("_key"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES))
    own = F.pmod(F.xxhash64("node"), blocks).alias("own")
    dealt = members.select("*", own).select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("with"))
    dealt = dealt.select("key", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node", "label", "sketch", "t")

    def compare(table: pa.Table) -> pa.Table:
        sets = [shingle_set(x.as_py()) for x in table.column("t")]
        sizes = np.array([len(x) for x in sets])
        low = np.array(table.column("sketch").to_pylist(), np.int64).view(np.uint8)
        nodes, labels = table.column("node").to_pylist(), table.column("label").to_pylist()
        side, i, j = table.column("own").to_numpy(), table.column("i")[0].as_py(), table.column("j")[0].as_py()
        root = {x: x for x in labels}

        def find(x: bytes) -> bytes:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        links = []
        for x in range(len(nodes)):
            if i != j and side[x] != i:
                continue
            near = ((low == low[x]).sum(axis=1) >= least_agreeing(percent)) & (100 * np.minimum(sizes, sizes[x]) >= percent * np.maximum(sizes, sizes[x]))
            near &= np.arange(len(nodes)) > x if i == j else side != i
            for y in np.flatnonzero(near).tolist():
                if find(labels[x]) != find(labels[y]):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= percent * (sizes[x] + sizes[y] - both):
                        root[find(labels[x])] = find(labels[y])
                        links.append((min(nodes[x], nodes[y]), max(nodes[x], nodes[y])))
        return pa.table({"a": pa.array([x[0] for x in links], pa.binary()), "b": pa.array([x[1] for x in links], pa.binary())})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a binary, b binary").distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, label) of every linked node: label is the smallest node reachable.

    Large-star and small-star steps in turn, each an aggregation by node and a
    join; a hub's neighbours are never gathered in one row.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    for _ in range(rounds):
        near = edges.union(edges.select("v", "u"))
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(large.where("u <> v").distinct())
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u")
        edges = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"links did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(roots)


def near_duplicates(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, component), one row per document.

    `component` is the component's smallest node, null for empty sets.
    """
    depth = depth_of(percent)
    signed = stored(signatures(docs, text, depth=depth))
    full = signed.where("n_shingles > 0")
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "n_shingles")).alias("r")
    classes = stored(full.groupBy("node").agg(pick, F.first("sig").alias("sig"), F.first("sketch").alias("sketch")).select("node", "r.doc_id", "r.text_hash", "r.n_shingles", "sig", "sketch"))
    ends = stored(leaves(classes, depth=depth))
    centers = ends.groupBy("key").agg(F.min("node").alias("a"))
    stars = ends.join(centers, "key").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    sketches = classes.select("node", "sketch")
    side = lambda n: sketches.select(F.col("node").alias(n), F.col("sketch").alias(f"s{n}"))
    close = stars.join(side("a"), "a").join(side("b"), "b").where(alike(F.col("sa"), F.col("sb"), percent))
    links = stored(confirm(close.select("a", "b"), docs, classes, text, percent))
    labels = stored(components(links))
    # nodes that still hold several components
    held = ends.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    sizes = held.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    most = sizes.groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    still = stored(held.join(most.select("key", "n", F.col("m.label").alias("largest")), "key").join(sketches, "node"))
    few = still.where(F.col("n") <= LEAF)
    minor = few.where("label <> largest").select("key", F.col("node").alias("x"), F.col("label").alias("lx"), F.col("sketch").alias("sx"))
    other = few.select("key", F.col("node").alias("y"), F.col("label").alias("ly"), F.col("sketch").alias("sy"), "largest")
    # a pair of two smaller components meets once, by the order of its nodes
    once = (F.col("ly") == F.col("largest")) | (F.col("x") < F.col("y"))
    other = other.withColumnRenamed("key", "_key")
    cross = minor.join(other, (F.col("key") == F.col("_key")) & (F.col("lx") != F.col("ly")) & once & alike(F.col("sx"), F.col("sy"), percent))
    more = cross.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    tried = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = more.join(tried, ["a", "b"], "left_anti")
    found = confirm(more, docs, classes, text, percent)
    many = still.where(F.col("n") > LEAF)
    bodies = texts_of(many.select("node").distinct(), docs, classes, text)
    found = stored(found.union(block_links(many.join(bodies, "node"), percent)))
    if found.limit(1).count():
        labels = stored(components(links.union(found)))
    named = classes.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "doc_id")
    named = stored(named)
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    ids = named.join(smallest, "label").select("node", "component_id", F.col("label").alias("component"))
    rows = signed.drop("sig", "sketch")
    linked = rows.where("n_shingles > 0").join(ids, "node").select("doc_id", "text_hash", "n_shingles", "component_id", "component")
    alone = rows.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("component"))
    return linked.union(alone)


def keep_one(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents, one of each component: that of the smallest doc_id. Documents without words all stay."""
    found = near_duplicates(docs, text, percent).where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    kept = found.groupBy("component").agg(first).select(F.col("first.doc_id").alias("kept_id"), F.col("first.text_hash").alias("kept_hash"))
    rows = whole_rows(docs, id=F.col("doc_id").cast("long"), hash=F.xxhash64(text_of(text)), worded=text_of(text).rlike(r"\S"))
    same_row = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash"))
    chosen = rows.where("worded").join(kept, same_row).dropDuplicates(["kept_id", "kept_hash"])
    return chosen.select("row.*").union(rows.where("not worded").select("row.*"))
