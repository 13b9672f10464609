"""Work along the time line of many keys, in slices whose bounds Spark samples from the rows.

A slice is a range of (key, time), so a key that holds a third of all rows
spreads over a third of the slices, and many small keys share one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import col, is_numeric
from ..session import materialize


def epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def micros(at: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", epoch(), at.cast("timestamp_ntz"))


def _place(df: DataFrame, at: str) -> Column:
    """Position on the line: microseconds of a date or time, a number as it is."""
    return col(at) if is_numeric(df.schema[at]) else micros(col(at))


def in_slices(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """The rows with `__slice`, the number of their range of `order`; written, so that all uses see the same bounds."""
    return materialize(df.repartitionByRange(*order).withColumn("__slice", F.spark_partition_id()))


def sessions(df: DataFrame, user: str, at: str, value: str | None = None, gap_seconds: float = 1800) -> DataFrame:
    """(user, start, end, events, total) of a table: activity split where a user is idle for the gap.

    The rows travel once, into slices of (user, time). An Arrow pass over
    each sorted slice holds one open session. Only the first and last
    session of a slice can go on in another: those, two a slice, are merged in
    a second step. Rows without a time are left out, rows without a user form one
    user; `end` is the last event and the gap, `total` is null without values.
    """
    gap = int(gap_seconds * 1_000_000)
    x = col(value).cast("double") if value else F.lit(None).cast("double")
    rows = df.where(col(at).isNotNull()).select(col(user).alias("user"), micros(col(at)).alias("t"), x.alias("x"))
    rows = rows.withColumn("h", F.xxhash64("x")).repartitionByRange("user", "t", "h").sortWithinPartitions("user", "t").drop("h")
    kind = T.StructType([rows.schema["user"]]).fields[0].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, first = TaskContext.get().partitionId(), None, True
        for batch in batches:
            if not len(batch):
                continue
            users, t = batch.column("user"), batch.column("t").to_numpy()
            x = batch.column("x").to_numpy(zero_copy_only=False)
            code = users.dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (t[1:] - t[:-1] >= gap)]))
            lasts = np.append(starts[1:], len(t)) - 1
            known = ~np.isnan(x)
            found = {
                "user": users.take(pa.array(starts)), "first": t[starts], "last": t[lasts], "events": lasts - starts + 1,
                "total": np.add.reduceat(np.where(known, x, 0.0), starts), "known": np.add.reduceat(known.astype(np.int64), starts),
            }
            pieces = pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in found.items()})
            if held is not None and held["user"] == users[0].as_py() and t[0] - held["last"] < gap:
                head = pieces.slice(0, 1).to_pylist()[0]
                joined = {**held, "last": head["last"], **{k: held[k] + head[k] for k in ("events", "total", "known")}}
                pieces = pa.concat_tables([pa.Table.from_pylist([joined], pieces.schema), pieces.slice(1)])
            elif held is not None:
                pieces = pa.concat_tables([pa.Table.from_pylist([held], pieces.schema), pieces])
            held = pieces.slice(len(pieces) - 1).to_pylist()[0]
            done = pieces.slice(0, len(pieces) - 1)
            if len(done):
                edge = np.zeros(len(done), bool)
                edge[0], first = first, False
                yield from marked(done, edge, part)
        if held is not None:
            yield from marked(pa.Table.from_pylist([held], pieces.schema), np.array([True]), part)

    def marked(done: pa.Table, edge: np.ndarray, part: int) -> Iterator[pa.RecordBatch]:
        out = done.append_column("edge", pa.array(edge)).append_column("part", pa.array(np.full(len(done), part, np.int32)))
        yield from out.to_batches()

    made = materialize(rows.mapInArrow(cut, f"user {kind}, first long, last long, events long, total double, known long, edge boolean, part int"))
    line = Window.partitionBy("user").orderBy("part", "first")  # two rows a slice
    open_ended = made.where("edge").withColumn("fresh", F.coalesce(F.col("first") - F.lag("last").over(line) >= gap, F.lit(True)).cast("int"))
    merged = (
        open_ended.withColumn("no", F.sum("fresh").over(line))
        .groupBy("user", "no")
        .agg(*[how(c).alias(c) for how, c in ((F.min, "first"), (F.max, "last"), (F.sum, "events"), (F.sum, "total"), (F.sum, "known"))])
        .drop("no")
    )
    whole = made.where("NOT edge").select(*merged.columns).unionByName(merged)
    moment = lambda c: F.timestamp_add("MICROSECOND", c, epoch())
    return whole.select(
        F.col("user").alias(user), moment(F.col("first")).alias("start"), moment(F.col("last") + gap).alias("end"), "events",
        F.when(F.col("known") > 0, F.col("total")).alias("total"),
    )


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time (left join).

    Times are dates, timestamps or numbers, of one kind on both sides. Both sides lie on one line of (key, time), cut into slices: a slice sees its own
    rows and the last right row that an earlier slice of the key hands on. Of right
    rows at one time the greatest by its columns counts. A left row without a time or with
    a null key finds nothing.
    """
    keys = list(keys)
    payload = [c for c in right.columns if c not in keys]
    names = [f"__k{i}" for i in range(len(keys))]
    of = lambda df: [col(k).alias(n) for k, n in zip(keys, names)]
    l = left.select(*of(left), _place(left, left_at).alias("__t"), F.lit(1).alias("__side"), F.struct(*[col(c) for c in left.columns]).alias("__l"))
    r = right.select(*of(right), _place(right, right_at).alias("__t"), F.lit(0).alias("__side"), F.struct(*[col(c) for c in payload]).alias("__r"))
    bound = F.col("__t").isNotNull()
    for n in names:
        bound = bound & F.col(n).isNotNull()
    line = in_slices(l.where(bound).unionByName(r.where(bound), allowMissingColumns=True), [*names, "__t", "__side"])
    inside = Window.partitionBy("__slice", *names).orderBy("__t", "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    matched = line.withColumn("__m", F.last("__r", ignorenulls=True).over(inside)).where("__side = 1")
    # the last right row of each slice and key; only keys that go on into the next slice have more than one slice
    ends = line.groupBy("__slice", *names).agg(F.max_by("__r", F.when(F.col("__side") == 0, F.struct("__t", "__r"))).alias("__last"))
    earlier = Window.partitionBy(*names).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__carry", F.last("__last", ignorenulls=True).over(earlier)).where("__carry is not null").drop("__last")
    out = matched.join(carried, ["__slice", *names], "left").select("__l", F.coalesce("__m", "__carry").alias("__m"))
    out = out.unionByName(l.where(~bound).select("__l"), allowMissingColumns=True)
    return out.select("__l.*", *[F.col("__m")[c].alias(c) for c in payload])
