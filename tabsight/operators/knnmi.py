"""Mutual information by nearest neighbours, for columns whose dependency is no step function of bins.

The estimate counts, for every row, how many rows lie closer in each single column than its
k-th neighbour lies in the plane of both. Values are scaled to unit deviation
and rounded to 2^-GRID_BITS of it, so all distances are whole numbers and ties are exact.

Equal points are counted first. Laid in Morton order, a point's neighbours in the
order share a cell of the quad tree with it: the least cell with k others bounds the
k-th distance, and the nine cells of that size around the point hold all that can be nearer. As no
cell of a size serves more than 4 k points of its own, a point is compared with few
others, and a crowd next to a lone point only with the lone one. Counts within a distance along one column are
differences of prefix counts, looked up by an as-of join in slices.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import number_of, numeric_columns
from ..functions.ranks import cumulative_counts
from ..session import materialize
from .timelines import asof_join, in_slices

GRID_BITS = 20
TOP = 31  # bits of a coordinate
# Fixed masks that spread 32 bits over the even places of 64.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def digamma(n: Column) -> Column:
    """psi of a whole number of at least 1, to some 1e-12: ten steps up, then the asymptotic series."""
    z = n.cast("double") + 10
    steps = sum((1 / (n.cast("double") + j) for j in range(10)), F.lit(0.0))
    return F.log(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * z * z * z * z) - 1 / (252 * z * z * z * z * z * z) - steps


def _shift(c: Column, bits) -> Column:
    return F.call_function("shiftright", c, bits if isinstance(bits, Column) else F.lit(bits))


def _morton(x: Column, y: Column) -> Column:
    def spread(c: Column) -> Column:
        for bits, mask in SPREAD:
            c = c.bitwiseOR(F.shiftleft(c, bits)).bitwiseAND(F.lit(mask).cast("long"))
        return c

    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def grid_points(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as whole numbers x0, x1, …: gaps filled with the mean, scaled to unit deviation.

    A column whose values span more than 2^(TOP - GRID_BITS) deviations is rounded to 2^-TOP of its span instead.
    """
    numbers = df.select(*[number_of(df, c).alias(f"x{i}") for i, c in enumerate(columns)])
    facts = [f(F.col(f"x{i}")).alias(f"{name}{i}") for i in range(len(columns)) for name, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))]
    row = numbers.agg(*facts).first()
    cells = []
    for i in range(len(columns)):
        mean, s, lo = row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0, row[f"lo{i}"] or 0.0
        reach = ((row[f"hi{i}"] or 0.0) - lo) / s
        fine = min(2.0**GRID_BITS, (2**TOP - 1) / reach) if reach else 1.0
        cells.append(F.floor((F.coalesce(F.col(f"x{i}"), F.lit(mean)) - lo) / s * fine).alias(f"x{i}"))
    return numbers.select(*cells)


def kth_distances(points: DataFrame, k: int) -> DataFrame:
    """(g, x, y, w, r): of each distinct point with w rows the distance from one of them to its k-th other row in group g.

    The distance is the greater of both coordinates' differences. Groups of k rows or fewer are left out.
    """
    totals = points.groupBy("g").agg(F.sum("w").alias("rows")).where(F.col("rows") > k).drop("rows")  # one row a pair of columns
    points = materialize(points.join(F.broadcast(totals), "g"))
    line = in_slices(points.withColumn("m", _morton(F.col("x"), F.col("y"))), ["g", "m"])
    order = Window.partitionBy("__slice", "g").orderBy("m")
    spans = [F.bin(F.lag("m", j).over(order).bitwiseXOR(F.lead("m", k - j).over(order))) for j in range(1, k)]
    spans += [F.bin(F.col("m").bitwiseXOR(F.lead("m", k).over(order))), F.bin(F.lag("m", k).over(order).bitwiseXOR(F.col("m")))]
    # a cell of the tree at level L has sides of 2^L; without k others in the slice the whole plane
    level = F.coalesce(F.array_min(F.array(*[F.ceil(F.length(s) / 2).cast("int") for s in spans])), F.lit(TOP + 1))
    asked = materialize(line.where(F.col("w") <= k).select("g", "x", "y", "w", level.alias("level")))
    levels = [r[0] for r in asked.select("level").distinct().collect()]  # at most TOP + 1
    near = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    cell = lambda c: _shift(F.col(c), F.col("level"))
    visits = asked.withColumn("n", F.explode(near)).select("g", "x", "y", "w", "level", (cell("x") + F.col("n.a")).alias("cx"), (cell("y") + F.col("n.b")).alias("cy"))
    held = points.withColumn("level", F.explode(F.array(*[F.lit(v) for v in sorted(levels)]).cast("array<int>")))
    held = held.select("g", "level", cell("x").alias("cx"), cell("y").alias("cy"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("w").alias("ow"))
    # Spark takes a list's rows for one, so it would send a side of many times the points' size to the driver
    met = visits.join(held.hint("merge"), ["g", "level", "cx", "cy"])
    far = F.greatest(F.abs(F.col("ox") - F.col("x")), F.abs(F.col("oy") - F.col("y")))
    met = met.select("g", "x", "y", "w", far.alias("d"), F.when(far == 0, F.col("w") - 1).otherwise(F.col("ow")).alias("ow"), "ox", "oy")
    nearest = Window.partitionBy("g", "x", "y").orderBy("d", "ox", "oy")
    # every point but the row's own counts at least one row, so k + 1 points are enough
    met = met.withColumn("no", F.row_number().over(nearest)).where(F.col("no") <= k + 1)
    met = met.withColumn("upto", F.sum("ow").over(nearest.rowsBetween(Window.unboundedPreceding, 0)))
    found = met.where(F.col("upto") >= k).groupBy("g", "x", "y", "w").agg(F.min("d").alias("r"))
    return found.unionByName(points.where(F.col("w") > k).select("g", "x", "y", "w", F.lit(0).cast("long").alias("r")))


def neighbor_information(df: DataFrame, columns: Sequence[str] | None = None, k: int = 3) -> DataFrame:
    """(i, j, col_a, col_b, mi) for every pair i < j, in nats and at least 0; 0 where there are k rows or fewer."""
    names = list(columns or numeric_columns(df))
    if len(names) < 2:
        raise ValueError("dependency needs at least two numeric columns")
    pairs = list(itertools.combinations(range(len(names)), 2))
    data = materialize(grid_points(df, names))
    cells = [F.struct(F.lit(g).alias("g"), F.col(f"x{i}").alias("x"), F.col(f"x{j}").alias("y")) for g, (i, j) in enumerate(pairs)]
    points = data.select(F.inline(F.array(*cells))).groupBy("g", "x", "y").agg(F.count(F.lit(1)).alias("w"))
    found = materialize(kth_distances(points, k))
    side = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    spots = [F.struct(F.lit(i).alias("c"), F.col(f"x{i}").alias("v")) for i in range(len(names))]
    counts = data.select(F.inline(F.array(*spots))).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    prefix = cumulative_counts(counts, ["c"], "v").select("c", F.col("v").alias("seen"), (F.col("below") + F.col("n")).alias("upto"))
    reach = F.greatest(F.col("r") - 1, F.lit(0))
    probe = lambda end, axis, c, at: F.struct(F.lit(end).alias("sign"), F.lit(axis).alias("axis"), side[F.col("g")][c].alias("c"), at.alias("t"))
    ends = [probe(s, a, c, F.col(a) + (reach if s > 0 else -reach - 1)) for a, c in (("x", "i"), ("y", "j")) for s in (1, -1)]
    probes = found.select("g", "x", "y", "w", F.inline(F.array(*ends)))
    placed = asof_join(probes, prefix, ["c"], "t", "seen")
    along = lambda a: F.sum(F.when(F.col("axis") == a, F.col("sign") * F.coalesce("upto", F.lit(0)))).alias(f"n{a}")
    within = placed.groupBy("g", "x", "y", "w").agg(along("x"), along("y"))
    terms = within.groupBy("g").agg(F.sum("w").alias("rows"), F.sum(F.col("w") * (digamma(F.col("nx")) + digamma(F.col("ny")))).alias("s"))
    mi = F.greatest(F.lit(0.0), digamma(F.col("rows")) + digamma(F.lit(k)) - F.col("s") / F.col("rows"))
    label = F.array(*[F.lit(n) for n in names])
    every = df.sparkSession.createDataFrame([(g, i, j) for g, (i, j) in enumerate(pairs)], "g int, i int, j int")
    out = every.join(F.broadcast(terms.select("g", mi.alias("mi"))), "g", "left")  # one row a pair of columns
    return out.select("i", "j", label[F.col("i")].alias("col_a"), label[F.col("j")].alias("col_b"), F.coalesce("mi", F.lit(0.0)).alias("mi"))
