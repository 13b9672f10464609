"""Sharding by minimax contiguous partition.

Texts that are equal are one atomic group; groups are ordered by their smallest
doc_id. The smallest capacity is searched for which a greedy walk over the
group sizes needs no more than the wanted shards, and the order is cut there.

The walk needs only sums of sizes up to some groups. The driver holds a coarse
list of such sums, knows between which of them it may be missing others, and
walks once as if nothing lay there and once as if everything did. Where the two
disagree, the sums of just those stretches are listed more finely, until both
name the same capacity.

Defined cases: a null text has size 8 and is the empty text; documents without
doc_id come first; repeated rows are one group with a slot each; a group larger
than an even share makes the capacity its own size; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import running_total, stored, text_of

SHARDS = 24
LISTED = 4096  # sums that one listing brings per stretch at the first pass
FINER = 256  # and at the next ones
HEADER = 8  # bytes that a row adds to its text


class Sums:
    """Sums of sizes up to some of the groups; `whole[i]` says that none is missing between points i and i + 1."""

    def __init__(self, points: np.ndarray, whole: np.ndarray):
        self.points, self.whole = points, whole

    def below(self, limit: int, hopeful: bool) -> int:
        """The largest sum up to `limit`: one that is known, or the largest that there could be."""
        i = int(np.searchsorted(self.points, limit, "right")) - 1
        if not hopeful or i + 1 == len(self.points) or self.whole[i]:
            return int(self.points[i])
        return min(limit, int(self.points[i + 1]) - 1)

    def cuts(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        out = [0]
        for _ in range(shards):
            out.append(self.below(out[-1] + capacity, hopeful))
        return out[1:]

    def least(self, low: int, total: int, shards: int, hopeful: bool) -> int:
        high = total
        while low < high:
            middle = (low + high) // 2
            if self.cuts(middle, shards, hopeful)[-1] >= total:
                high = middle
            else:
                low = middle + 1
        return low

    def refine(self, found: list[tuple[int, int, int]], stretches: list[int]) -> Sums:
        """Put the (stretch, smallest, largest, rows) of the buckets of some stretches in their place."""
        points, whole = [], []
        at = 0
        by_stretch: dict[int, list] = {}
        for stretch, *bucket in found:
            by_stretch.setdefault(stretch, []).append(bucket)
        chosen = set(stretches)
        for at in range(len(self.points)):
            points.append(int(self.points[at]))
            if at == len(self.points) - 1:
                break
            if at not in chosen:
                whole.append(bool(self.whole[at]))
                continue
            for least, most, rows in sorted(by_stretch.get(at, [])):
                whole.append(True)  # buckets follow each other
                points.append(least)
                if most > least:
                    whole.append(rows == 2)
                    points.append(most)
            whole.append(True)
        return Sums(np.array(points, np.int64), np.array(whole, bool))


def minimax_cuts(groups: DataFrame, upto: str, size: str, shards: int = SHARDS) -> list[int]:
    """Sums of sizes at which the order is cut, one per shard; `upto` is the running sum over the groups."""
    total, largest = groups.agg(F.max(upto), F.max(size)).first()
    if total is None:
        return []
    sums = Sums(np.array([0, total], np.int64), np.array([False]))
    low, buckets = max(-(-total // shards), largest), LISTED
    while True:
        sure = sums.least(low, total, shards, hopeful=False)
        hoped = sums.least(low, total, shards, hopeful=True)
        if sure == hoped:
            return sums.cuts(sure, shards, hopeful=False)
        stretches: set[int] = set()
        for first, last in zip(sums.cuts(hoped, shards, False), sums.cuts(sure, shards, True)):
            i, j = np.searchsorted(sums.points, [first, last], "right") - 1
            stretches.update(k for k in range(max(0, int(i)), min(int(j), len(sums.whole) - 1) + 1) if not sums.whole[k])
        chosen = sorted(stretches)
        found = _listing(groups, upto, sums.points, chosen, buckets)
        sums, buckets = sums.refine(found, chosen), FINER


def _listing(groups: DataFrame, upto: str, points: np.ndarray, chosen: list[int], buckets: int) -> list[tuple]:
    """Smallest and largest sum, and their number, in each bucket of the chosen stretches."""
    spark = groups.sparkSession
    ranges = spark.createDataFrame([(k, int(points[k]), int(points[k + 1])) for k in chosen], "stretch long, low long, high long")
    inside = F.col(upto).between(F.col("low") + 1, F.col("high") - 1)
    bucket = F.expr(f"({upto} - low - 1) div greatest(1, (high - low + {buckets - 1}) div {buckets})")
    # at most a few stretches a cut
    rows = groups.select(upto).join(F.broadcast(ranges), inside).groupBy("stretch", bucket.alias("bucket")).agg(F.min(upto), F.max(upto), F.count(F.lit(1)))
    return [(r[0], r[2], r[3], r[4]) for r in rows.collect()]


def number_of(cuts: list[int], upto: Column) -> Column:
    """The shard of a group: how many cuts lie before its end."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < upto))


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", header: int = HEADER) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): slots of a shard are gapless from 0, in the order of groups and doc_ids."""
    t = text_of(text)
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long"),
            (F.octet_length(t) + F.lit(header)).cast("long").alias("size"),
            F.crc32(t.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(t, 256)).alias("content"),
        )
    )
    first = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    groups = rows.groupBy("content").agg(F.sum("size").alias("bytes"), F.min(first).alias("first"), F.count(F.lit(1)).alias("rows"))
    placed = stored(running_total(groups, ["first", "content"], {"upto": "bytes", "rows_upto": "rows"}))
    cuts = minimax_cuts(placed, "upto", "bytes", shards)
    if not cuts:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    at_cut = dict(placed.where(F.col("upto").isin(cuts)).select("upto", "rows_upto").collect())  # one row a cut
    before = [0] + [at_cut.get(c, 0) for c in cuts[:-1]]
    known = rows.join(placed.select("content", "first", "upto"), "content")
    ordered = running_total(known.withColumn("one", F.lit(1).cast("long")), ["first", "content", "doc_id"], {"place": "one"})
    number = number_of(cuts[:-1], F.col("upto"))
    start = F.get(F.array(*[F.lit(int(b)).cast("long") for b in before]), F.col("shard"))
    return ordered.withColumn("shard", number).select("doc_id", "size", "text_crc32", "shard", (F.col("place") - 1 - start).alias("slot"))
