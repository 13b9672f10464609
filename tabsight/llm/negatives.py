"""Hard negatives by the threshold algorithm over sorted lists, one list per dimension.

Candidates are dealt into blocks of bounded size. In a block every dimension
has its rows in order of that component. An anchor reads all lists at once,
from the top where its own component is positive and from the bottom where it
is negative; each row that shows up is scored exactly by random access. The
products of the anchor with the components read last, summed, bound the score
of every row not seen yet, so reading stops when that threshold falls strictly
below the k-th score of each window, or below the window itself.

Two rounds: the best rows of the anchor's own label (its positives), in blocks
of that label, and then, in blocks of all rows, the best rows of other labels
whose score lies between `least` percent of a positive's score and that score.
A task holds one block and one group of anchors; the k best of each block are
merged by rank.

Defined cases: rows without label or vector, or with a null or non-finite
component, take no part. Shorter vectors end in zeros. Every row counts, so
rows with the same id are different candidates and different anchors, and an
anchor is no positive of itself. Ties go to the smaller id, a null id last. A
positive with a negative score has an empty window. Components and scores
beyond 64 bits are cut to that range. Other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stored

K = 5
LEAST = 80  # percent of the positive's score from which a negative counts
BLOCK = 8192  # candidate rows in one task
ANCHORS = 1024  # anchors in one task
START = 16  # rows of each list that are read before the first look at the threshold
LONG = 2**63 - 1


def whole_components(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as 64-bit integers; null if the vector or a component is null or not finite."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


class Lists:
    """The rows of a block, and the order of their components in each dimension."""

    def __init__(self, vectors: list[list[int]], ids: list[int | None], width: int):
        n = len(vectors)
        largest = max((abs(x) for v in vectors for x in (min(v, default=0), max(v, default=0))), default=0)
        self.largest, self.ids = largest, ids
        self.nulls = np.array([i is None for i in ids], bool)
        self.numbers = np.array([i or 0 for i in ids], np.int64)
        whole = np.zeros((n, width), np.int64)
        for row, v in zip(whole, vectors):
            row[: len(v)] = v
        self.order = np.argsort(whole, axis=0, kind="stable").T.copy()
        self.whole = whole
        self.rows = whole.astype(np.float64)

    def exact(self, anchor: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, anchor) in the narrowest numbers whose sums of products are exact."""
        biggest = max((abs(x) for x in anchor), default=0)
        width = self.whole.shape[1]
        a = [*anchor, *[0] * (width - len(anchor))]
        if biggest * self.largest * max(width, 1) < 2**53:
            return self.rows, np.array(a, np.float64)
        return self.whole.astype(object), np.array([int(x) for x in a], object)


def _cut(score):
    """The score within 64 bits."""
    return max(-LONG - 1, min(LONG, score))


def best_of_windows(lists: Lists, anchor: list[int], allowed: np.ndarray, windows: list[tuple[float, float]], k: int) -> list[list[tuple[int, int]]]:
    """For each window (low, high) the k best (score, row) of the allowed rows within it, ties by id."""
    rows, a = lists.exact(anchor)
    n = len(rows)
    up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
    met = np.zeros(n, bool)
    scores, found = np.empty(0, a.dtype), np.empty(0, np.int64)
    lowest, highest = min(w[0] for w in windows), max(w[1] for w in windows)
    before, depth = 0, START
    while True:
        depth = min(depth, n)
        fresh = np.zeros(n, bool)
        if depth == n or len(up) + len(down) == 0:
            fresh[:] = True
            depth = n
        else:
            fresh[lists.order[up, n - depth : n - before]] = True
            fresh[lists.order[down, before:depth]] = True
        fresh &= ~met
        met |= fresh
        at = np.flatnonzero(fresh & allowed)
        value = rows[at] @ a if len(at) else np.empty(0, a.dtype)
        if a.dtype == object:
            value = np.array([_cut(x) for x in value], object)
        fits = (value >= lowest) & (value <= highest)
        scores, found = np.concatenate([scores, value[fits]]), np.concatenate([found, at[fits]])
        if depth == n:
            break
        last = _cut(sum(rows[lists.order[d, n - depth], d] * a[d] for d in up) + sum(rows[lists.order[d, depth - 1], d] * a[d] for d in down))
        floors = []
        for low, high in windows:
            inside = np.sort(scores[(scores >= low) & (scores <= high)])
            floors.append(max(low, inside[-k]) if len(inside) >= k else low)
        if last < min(floors):
            break
        before, depth = depth, depth * 4
    out = []
    for low, high in windows:
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        if len(inside) > k:  # all that reach the k-th score
            inside = inside[scores[inside] >= np.sort(scores[inside])[-k]]
        ranked = sorted(((-int(scores[i]), bool(lists.nulls[found[i]]), int(lists.numbers[found[i]]), int(found[i])) for i in inside))
        out.append([(-s, row) for s, _, _, row in ranked[:k]])
    return out


def _renamed(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for a cogroup of two views of one table."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


def _table(columns: dict[str, list], types: dict[str, pa.DataType]) -> pa.Table:
    return pa.table({name: pa.array(columns[name], t) for name, t in types.items()})


def _lists(task: pa.Table, known: pa.Table) -> Lists:
    vectors = known.column("q").to_pylist()
    width = max((len(v) for c in (vectors, task.column("q").to_pylist()) for v in c), default=0)
    return Lists(vectors, known.column("id").to_pylist(), width)


def positives(rows: DataFrame, k: int = K) -> DataFrame:
    """(row, no, positive_id, positive_score): the k best other rows of the label of each anchor; no counts from 1.

    `rows` has row (a number for each row), id, label, anchor (boolean) and q.
    """
    sizes = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if("anchor").alias("m")).where("m > 0")
    counted = rows.join(sizes.select("label", F.ceil(F.col("n") / BLOCK).alias("blocks"), F.ceil(F.col("m") / ANCHORS).alias("groups")), "label")
    part = lambda n: F.pmod(F.xxhash64("row"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    asked = counted.where("anchor").select("label", "row", "q", "blocks", part(F.col("groups")).alias("g")).select("label", "row", "q", "g", every(F.col("blocks")).alias("b"))
    known = counted.select("label", "row", "id", "q", "groups", part(F.col("blocks")).alias("b")).select("label", "row", "id", "q", "b", every(F.col("groups")).alias("g"))
    types = {"row": pa.int64(), "positive_id": pa.int64(), "positive_score": pa.int64()}

    def search(anchors: pa.Table, block: pa.Table) -> pa.Table:
        out = {name: [] for name in types}
        if len(anchors) and len(block):
            lists, own = _lists(anchors, block), block.column("row").to_numpy()
            for row, q in zip(anchors.column("row").to_pylist(), anchors.column("q").to_pylist()):
                for score, at in best_of_windows(lists, q, own != row, [(-float("inf"), float("inf"))], k)[0]:
                    out["row"].append(row)
                    out["positive_id"].append(lists.ids[at])
                    out["positive_score"].append(score)
        return _table(out, types)

    found = asked.groupBy("label", "b", "g").cogroup(_renamed(known).groupBy("label", "b", "g")).applyInArrow(search, "row long, positive_id long, positive_score long")
    order = Window.partitionBy("row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    return found.withColumn("no", F.row_number().over(order)).where(F.col("no") <= k)


def mine(rows: DataFrame, k: int = K, least: int = LEAST) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `rows` has id, label, anchor (whether the row is an anchor) and q, the vector
    as 64-bit integers, null where the row takes no part.
    """
    part = rows.where("label IS NOT NULL AND q IS NOT NULL")
    anchor = F.coalesce(F.col("anchor"), F.lit(False)).alias("anchor")
    numbered = stored(part.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), "label", anchor, "q"))
    n, m = numbered.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-m // ANCHORS))
    windows = positives(numbered, k).where("positive_score >= 0")
    windows = windows.groupBy("row").agg(F.array_sort(F.array_agg(F.struct("no", "positive_id", "positive_score"))).alias("windows"))  # k entries at most
    # both sides must number blocks and groups in one type: equal numbers of two types are dealt to different tasks
    part_of = lambda count: F.pmod(F.xxhash64("row"), F.lit(count).cast("long")).alias
    every = lambda count, name: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias(name)
    asked = numbered.where("anchor").join(windows, "row").select("row", "id", "label", "q", "windows", part_of(groups)("g"), every(blocks, "b"))
    known = numbered.select("row", "id", "label", "q", part_of(blocks)("b"), every(groups, "g"))
    types = {"row": pa.int64(), "no": pa.int32(), "anchor_id": pa.int64(), "positive_id": pa.int64(), "positive_score": pa.int64(), "negative_id": pa.int64(), "negative_score": pa.int64()}

    def search(anchors: pa.Table, block: pa.Table) -> pa.Table:
        out = {name: [] for name in types}
        if len(anchors) and len(block):
            lists = _lists(anchors, block)
            labels = np.array(block.column("label").to_pylist(), object)
            for a in anchors.to_pylist():
                bounds = [(-(-least * w["positive_score"] // 100), w["positive_score"]) for w in a["windows"]]
                for w, best in zip(a["windows"], best_of_windows(lists, a["q"], labels != a["label"], bounds, k)):
                    for score, at in best:
                        values = (a["row"], w["no"], a["id"], w["positive_id"], w["positive_score"], lists.ids[at], score)
                        for name, value in zip(types, values):
                            out[name].append(value)
        return _table(out, types)

    schema = "row long, no int, anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    found = asked.groupBy("b", "g").cogroup(_renamed(known).groupBy("b", "g")).applyInArrow(search, schema)
    order = Window.partitionBy("row", "no").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
