"""Value counts, exact ranks and exact quantiles without a global sort in one task.

A value that fills a third of the table is one row here: counting happens
before every ordering step, map side first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .columns import number_of, present, value_key, col, scalar_columns

SKETCH = 10_000  # accuracy of the sketch that brackets quantiles
FEW_BRACKETS = 5  # quantiles of an expression up to which generated code counts their values
SLICE_CELLS = 500_000  # cells that one task ranks, some 50 MB of Arrow and numpy arrays


def melt(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per present cell: (pos, column, value, number)."""
    names = list(columns) if columns is not None else scalar_columns(df)
    cells = []
    for i, name in enumerate(names):
        cells.append(
            F.struct(
                F.lit(i).alias("pos"),
                F.lit(name).alias("column"),
                F.when(present(df, name), value_key(col(name), df.schema[name])).alias("value"),
                number_of(df, name).alias("number"),
            )
        )
    return df.select(F.inline(F.array(*cells))).where("value is not null")


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(pos, column, value, n): the count of every distinct present value."""
    return melt(df, columns).groupBy("pos", "column", "value").agg(F.count(F.lit(1)).alias("n"))


def cumulative_counts(counts: DataFrame, by: Sequence[str], value: str, n: str = "n") -> DataFrame:
    """Add `below` (rows with a smaller value in the group) and `total`.

    `counts` holds one row per (by, value). Rows are range-partitioned by
    (by, value); each slice is summed on its own and shifted by the totals of
    the slices before it, of which there are at most as many as partitions.
    The slices are checkpointed: both uses must see the same boundaries.
    """
    by = list(by)
    sliced = materialize(
        counts.select(*by, value, n)
        .repartitionByRange(*by, value)
        .withColumn("slice", F.spark_partition_id())
    )
    inside = Window.partitionBy(*by, "slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*by, "slice").agg(F.sum(n).alias("slice_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    totals = totals.select(
        *by,
        "slice",
        F.coalesce(
            F.sum("slice_n").over(group.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("offset"),
        F.sum("slice_n").over(group).alias("total"),
    )
    return (
        sliced.withColumn("inside", F.coalesce(F.sum(n).over(inside), F.lit(0)))
        .join(totals, [*by, "slice"])
        .select(*by, value, n, (F.col("offset") + F.col("inside")).alias("below"), "total")
    )


def average_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, value, rank) with ties averaged, rank 1 for the smallest value."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    ranked = cumulative_counts(counts, by, value)
    return ranked.select(*by, value, (F.col("below") + (F.col("n") + 1) / F.lit(2.0)).alias("rank"), "n", "below", "total")


def _cell_slices(cells: DataFrame) -> DataFrame:
    """The cells range-partitioned by (g, v, id) and sorted: as many slices as there are times SLICE_CELLS cells."""
    spark = cells.sparkSession
    n = max(spark.sparkContext.defaultParallelism, -(-cells.count() // SLICE_CELLS))
    ordered = cells.select("g", "id", (F.col("v") + F.lit(0.0)).alias("v"))
    return ordered.repartitionByRange(n, "g", "v", "id").sortWithinPartitions("g", "v")


def row_ranks(cells: DataFrame) -> DataFrame:
    """(g, id, rank) of every cell (g, id, v): average rank of v within g, no join by value.

    Cells are range-partitioned by (g, v, id), so a frequent value spreads over
    as many slices as its share asks for. A slice, sorted, counts its own runs of equal
    values in one Arrow pass; only the first and last run of a slice can go on
    in another one, and those, two a slice and group, are added up and broadcast.
    A task holds the cells of its slice, whose number grows with the cells. g is an int, v a double
    without null, (g, id) is unique.
    """
    def count_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(len(b) for b in held):
            return
        table = pa.Table.from_batches(held)
        g, v = table.column("g").to_numpy(), table.column("v").to_numpy()
        fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (v[1:] != v[:-1])])
        starts = np.flatnonzero(fresh)
        n = np.diff(np.append(starts, len(g)))
        group_start = np.maximum.accumulate(np.where(np.concatenate([[True], g[1:] != g[:-1]]), np.arange(len(g)), 0))
        run = np.cumsum(fresh) - 1
        table = table.append_column("below", pa.array((starts - group_start[starts])[run])).append_column("n", pa.array(n[run]))
        table = table.append_column("slice", pa.array(np.full(len(g), TaskContext.get().partitionId(), dtype=np.int32)))
        yield from table.to_batches(max_chunksize=1 << 16)
        del held, table, g, v, fresh, starts, n, group_start, run
        pa.default_memory_pool().release_unused()  # workers serve many tasks

    kind = cells.schema["id"].dataType.simpleString()
    placed = materialize(_cell_slices(cells).mapInArrow(count_runs, f"g int, id {kind}, v double, below long, n long, slice int"))
    slices = placed.groupBy("g", "slice").agg(
        F.count(F.lit(1)).alias("size"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.min_by("n", "v").alias("n0"), F.max_by("n", "v").alias("n1")
    )
    before = Window.partitionBy("g").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # slices, not rows
    slices = materialize(slices.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0))))
    first = F.struct(F.col("v0").alias("v"), F.col("n0").alias("n"), F.col("offset").alias("below"))
    last = F.struct(F.col("v1").alias("v"), F.col("n1").alias("n"), (F.col("offset") + F.col("size") - F.col("n1")).alias("below"))
    edges = slices.select("g", F.inline(F.array_distinct(F.array(first, last))))
    edges = edges.groupBy("g", "v").agg(F.sum("n").alias("all_n"), F.min("below").alias("all_below"))
    out = placed.join(F.broadcast(slices.select("g", "slice", "offset")), ["g", "slice"]).join(F.broadcast(edges), ["g", "v"], "left")
    below, n = F.coalesce("all_below", F.col("offset") + F.col("below")), F.coalesce("all_n", "n")
    return out.select("g", "id", (below + (n + 1) / F.lit(2.0)).alias("rank"))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, q) where q is the array of linearly interpolated quantiles.

    Without groups a sketch brackets each quantile, and only the values inside
    the brackets are ranked. With groups equal values are counted per group, map
    side first, and the counts are ranked in slices of (group, value).
    """
    by = list(by)
    if not by:
        found = _bracketed(df, [F.col(value)], probs).select("q")
        return found if found.limit(1).count() else df.sparkSession.range(1).select(F.lit(None).cast("array<double>").alias("q"))
    data = df.where(F.col(value).isNotNull())
    return _ranked(data.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n")), value, probs, by)


def _ranked(counts: DataFrame, value: str, probs: Sequence[float], by: list[str]) -> DataFrame:
    """Quantiles from the counts of all values."""
    counts = counts.withColumn("bracket", F.lit(0))
    placed = cumulative_counts(counts, [*by, "bracket"], value)
    k = len(probs)
    return _interpolated(placed, value, probs, by, [F.col("total")] * k, [F.col("below")] * k, [F.lit(0)] * k)


def _interpolated(placed, value, probs, by, totals, belows, brackets) -> DataFrame:
    """Linear interpolation between the values at the floor and ceiling positions of each probability."""
    picks = []
    for i, p in enumerate(probs):
        spot = F.lit(float(p)) * (totals[i] - 1)
        for name, position in (("lo", F.floor(spot)), ("hi", F.ceil(spot))):
            hit = (F.col("bracket") == brackets[i]) & (belows[i] <= position) & (position < belows[i] + F.col("n"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"{name}{i}"))
        picks.append(F.max(totals[i]).alias(f"t{i}"))
    found = placed.groupBy(*by).agg(*picks)
    parts = []
    for i, p in enumerate(probs):
        spot = F.lit(float(p)) * (F.col(f"t{i}") - 1)
        parts.append(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (spot - F.floor(spot)))
    return found.select(*by, F.array(*parts).alias("q"))


def _bracket_counts(df: DataFrame, cells: Sequence[Column], ends: dict[tuple[int, int], tuple[float, float]]) -> DataFrame:
    """(pos, bracket, v, n): the values inside the brackets, counted in an Arrow pass over all columns.

    Code generated for so many brackets is too long for the virtual machine to compile.
    """
    some = sorted({i for i, _ in ends})
    bounds = {i: [(j, *ends[p, j]) for p, j in ends if p == i] for i in some}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for at, i in enumerate(some):
                values, n = np.unique(batch.column(at).drop_null().to_numpy(zero_copy_only=False), return_counts=True)
                for j, low, high in bounds[i]:
                    a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
                    if b > a:
                        found.append((np.full(b - a, i, np.int32), np.full(b - a, j, np.int32), values[a:b], n[a:b]))
            if found:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*found)], names=["pos", "bracket", "v", "n"])

    known = df.select(*[cells[i].alias(f"c{i}") for i in some])
    return known.mapInArrow(count, "pos int, bracket int, v double, n long").groupBy("pos", "bracket", "v").agg(F.sum("n").alias("n"))


def _bracketed(df: DataFrame, cells: Sequence[Column], probs: Sequence[float]) -> DataFrame:
    """(pos, q): quantiles of several expressions, those without values left out.

    A sketch per expression, a few thousand numbers, is off by at most
    1 / SKETCH of the rows, so a bracket of a few times that width holds the
    wanted values. Bracket ends are literals in the second scan: only values
    inside are shuffled, well under a thousandth of the rows per probability.
    """
    margin = 4.0 / SKETCH
    k = len(probs)
    near = F.array(*[F.lit(v) for v in [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]])
    cells = [c.cast("double") for c in cells]
    sketch = df.agg(*[F.percentile_approx(c, near, F.lit(SKETCH)).alias(f"s{i}") for i, c in enumerate(cells)]).first()
    ends = {}
    for i in range(len(cells)):
        if sketch[i] is not None:
            for j, p in enumerate(probs):
                ends[i, j] = (float("-inf") if p - margin <= 0 else sketch[i][j], float("inf") if p + margin >= 1 else sketch[i][k + j])
    if not ends:
        return df.sparkSession.createDataFrame([], "pos int, q array<double>")
    some = sorted({i for i, _ in ends})
    sums = [F.count(cells[i]).alias(f"rows{i}") for i in some] + [F.count_if(cells[i] < low).alias(f"under{i}_{j}") for (i, j), (low, _) in ends.items()]
    outside = df.agg(*sums).first()
    if k > FEW_BRACKETS:
        counts = _bracket_counts(df, cells, ends)
    else:
        held = [
            F.when((cells[i] >= low) & (cells[i] <= high), F.struct(F.lit(i).alias("pos"), F.lit(j).alias("bracket"), cells[i].alias("v")))
            for (i, j), (low, high) in ends.items()
        ]
        counts = df.select(F.inline(F.array_compact(F.array(*held)))).groupBy("pos", "bracket", "v").agg(F.count(F.lit(1)).alias("n"))
    placed = cumulative_counts(counts, ["pos", "bracket"], "v").drop("total")
    facts = [(i, j, outside[f"rows{i}"], outside[f"under{i}_{j}"]) for i, j in ends]
    facts = df.sparkSession.createDataFrame(facts, "pos int, bracket int, rows long, under long")
    placed = placed.join(F.broadcast(facts), ["pos", "bracket"])  # one row per quantile
    belows = [F.col("below") + F.col("under")] * k
    found = materialize(_interpolated(placed, "v", probs, ["pos"], [F.col("rows")] * k, belows, [F.lit(j) for j in range(k)]))
    missed = [r["pos"] for r in found.where(F.exists("q", lambda v: v.isNull())).select("pos").collect()]
    if not missed:
        return found
    # a bracket without its value: rank all values of those expressions
    whole = [F.struct(F.lit(i).alias("pos"), cells[i].alias("v")) for i in missed]
    every = df.select(F.inline(F.array(*whole))).where("v is not null").groupBy("pos", "v").agg(F.count(F.lit(1)).alias("n"))
    return found.where(~F.col("pos").isin(missed)).union(_ranked(every, "v", probs, ["pos"]))


def column_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(column, q) for several numeric columns in two scans."""
    found = _bracketed(df, [number_of(df, c) for c in columns], probs)
    names = F.array(*[F.lit(c) for c in columns])
    return found.select(F.get(names, F.col("pos")).alias("column"), "q")
