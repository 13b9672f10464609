"""Read-only SQL over named tables, and the joins Spark SQL has no syntax for."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.columns import col
from .ingest import sanitize_result
from .timelines import in_slices

# Words that are refused anywhere in the text, in any case.
FORBIDDEN = (
    "INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "TRUNCATE", "ATTACH", "COPY", "EXPORT", "IMPORT", "PRAGMA", "CALL",
)
# Calls that reach out of the query, and the clause that makes names from text.
REACHING = ("identifier", "reflect", "java_method", "try_reflect", "input_file_name", "read_files")
_CALL = re.compile(r"(?<![\w.])`?\b(" + "|".join(REACHING) + r")`?\s*\(|\.\s*`?\b(" + "|".join(REACHING) + r")`?\s*\(", re.IGNORECASE)
# Raw strings end at the next quote, others skip what a backslash covers; quoted names may hold quotes.
_APART = re.compile(
    r"""(?P<name>`(?:[^`]|``)*`)|\b[rR](?:'[^']*'|"[^"]*")|'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|--(?:\\\n|[^\r\n])*|/\*(?P<comment>.*?)\*/""",
    re.DOTALL,
)
_WORDS = re.compile(r"\b(" + "|".join(FORBIDDEN) + r")\b", re.IGNORECASE)


class QueryRefused(ValueError):
    """The text is not a read-only query."""


def check_read_only(text: str) -> str:
    text = text.strip()
    if not text:
        raise QueryRefused("the query is empty")
    word = _WORDS.search(text)
    if word:
        raise QueryRefused(f"{word.group(0).upper()} is not allowed")
    if not text.upper().startswith(("SELECT", "WITH")):
        raise QueryRefused("a query starts with SELECT or WITH")
    return text


def check_calls(text: str) -> None:
    """Refuse calls into the virtual machine and names made from text, outside strings and comments."""

    def apart(found: re.Match) -> str:
        if "/*" in (found["comment"] or ""):
            raise QueryRefused("comments within comments are not allowed")
        return found["name"] or " "

    bare = _APART.sub(apart, text)
    if "global_temp" in bare.lower():
        raise QueryRefused("global_temp is not one of the tables")
    call = _CALL.search(bare)
    if call:
        raise QueryRefused(f"{call.group(1) or call.group(2)} is not allowed")


def guarded_session(spark: SparkSession, tables: Mapping[str, DataFrame]) -> SparkSession:
    """A session with the settings of the given one, in which only the given tables have names and files can't be read by path."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in tables.items():
        shared = f"guarded_{uuid.uuid4().hex}"
        df.createGlobalTempView(shared)
        session.table(f"global_temp.{shared}").createOrReplaceTempView(name)
        spark.catalog.dropGlobalTempView(shared)
    return session


def read_only_sql(spark: SparkSession, tables: Mapping[str, DataFrame], text: str) -> DataFrame:
    """The query's whole result; tables are visible under their names.

    The text runs in a session of its own. What it reads is judged after
    Spark's analysis: a relation that isn't given has no name there, and a
    table of another database shows by its files.
    """
    text = check_read_only(text)
    check_calls(text)
    session = guarded_session(spark, tables)
    try:
        found = session.sql(text)
    except AnalysisException as e:
        if e.getCondition() in ("TABLE_OR_VIEW_NOT_FOUND", "UNRESOLVABLE_TABLE_VALUED_FUNCTION", "UNSUPPORTED_DATASOURCE_FOR_DIRECT_QUERY"):
            raise QueryRefused(f"not one of the tables: {e.getMessageParameters() or ''}") from e
        raise
    given = {f for df in tables.values() for f in df.inputFiles()}
    if not set(found.inputFiles()) <= given:
        raise QueryRefused("the query reads files of other tables")
    return found


def present_sql(spark: SparkSession, tables: Mapping[str, DataFrame], text: str, cap: int = 1000):
    """(rows, truncated, milliseconds): at most `cap` presentable rows and the time they took."""
    start = time.perf_counter()
    rows = sanitize_result(read_only_sql(spark, tables, text), cap).collect()  # at most `cap` rows
    elapsed = (time.perf_counter() - start) * 1000.0
    return [r.asDict() for r in rows], bool(rows and rows[0]["truncated"]), elapsed


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """QUALIFY row_number() <= n; Spark drops rows beyond n before the shuffle."""
    w = Window.partitionBy(*[col(c) for c in by]).orderBy(*order)
    return df.withColumn("__rk", F.row_number().over(w)).where(F.col("__rk") <= n).drop("__rk")


def dyadic_cover(first: Column, last: Column) -> Column:
    """Array of (level, node): the fewest nodes of a binary tree over the whole numbers that make up first..last.

    Node i of level k holds the numbers from i * 2^k on, 2^k of them; there are at most two nodes a level.
    """
    shift = lambda x, k: F.call_function("shiftright", x, k)
    node = lambda k, i: F.struct(k.alias("level"), i.alias("node"))

    def at(k: Column) -> Column:
        low, high = -shift(-first, k), shift(last + 1, k)  # the numbers low..high-1 of level k lie within
        left = F.when((low < high) & (low.bitwiseAND(F.lit(1).cast("long")) == 1), node(k, low))
        right = F.when((low < high) & (high.bitwiseAND(F.lit(1).cast("long")) == 1), node(k, high - 1))
        return F.array(left, right)

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(62)), at)))


def range_join(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, width: float, keys: Sequence[str] = ()) -> DataFrame:
    """Inner join on low <= at < high (and equal keys) as an equi join of tree nodes.

    The axis is cut into cells of `width`, over which lies a binary tree. A range
    becomes the few nodes that make up its cells (two a level at most, however
    long it is), a point the nodes above its cell on the levels that ranges use;
    a range and a point within it share exactly one. `width` decides how many
    points beside a range are looked at, not how many rows a range becomes.
    """
    cell = lambda c: F.floor(col(c).cast("double") / width)
    cover = dyadic_cover(cell(low), cell(high))
    right = ranges.where(col(low) < col(high)).withColumn("__n", F.explode(cover)).withColumn("__level", F.col("__n.level")).withColumn("__node", F.col("__n.node")).drop("__n")
    levels = [r[0] for r in right.select("__level").distinct().collect()]  # at most 63
    above = F.explode(F.array(*[F.lit(k) for k in sorted(levels)]).cast("array<int>"))
    left = points.withColumn("__level", above).withColumn("__node", F.call_function("shiftright", cell(at), F.col("__level")))
    return left.join(right, [*keys, "__level", "__node"]).where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__level", "__node")


def range_totals(points: DataFrame, at: str, amount: str, ranges: DataFrame, low: str, high: str, by: Sequence[str]) -> DataFrame:
    """(by, n, total): number and sum of `amount` of the (range, point) pairs with low <= at < high, by columns of the ranges.

    The same as grouping `range_join` by these columns, without its pairs: points are summed by value, values and the
    ends of the ranges lie on one line in slices, and a range is what lies before its high end less what lies
    before its low one. Rows grow with points and ranges, however many points a range holds. `amount` is
    a whole or decimal number, so that differences are exact. As in a join, groups without a pair are left out.
    """
    if not isinstance(points.schema[amount].dataType, (T.IntegralType, T.DecimalType)):
        raise ValueError(f"range_totals needs whole or decimal numbers, {amount} has none")
    by = list(by)
    values = points.where(col(at).isNotNull()).groupBy(col(at).alias("__at"))
    values = values.agg(F.count(F.lit(1)).alias("__n"), F.count(col(amount)).alias("__known"), F.sum(col(amount)).alias("__sum"), F.lit(1).alias("__side"))
    ends = F.array(F.struct(col(low).alias("at"), F.lit(-1).alias("sign")), F.struct(col(high).alias("at"), F.lit(1).alias("sign")))
    ends = ranges.where(col(low) < col(high)).select(F.struct(*[col(c) for c in by]).alias("__by"), F.explode(ends).alias("__e"))
    ends = ends.select("__by", F.col("__e.at").alias("__at"), F.col("__e.sign").alias("__sign"), F.lit(0).alias("__side"), F.xxhash64("__by").alias("__h"))
    # an end comes before the points at its place; many equal ends spread by hash
    line = in_slices(values.unionByName(ends, allowMissingColumns=True), ["__at", "__side", "__h"])
    amounts = ("__n", "__known", "__sum")
    inside = Window.partitionBy("__slice").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(F.lit(0)).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)  # slices, not rows
    sums = line.groupBy("__slice").agg(*[F.sum(c).alias(c) for c in amounts])
    offsets = sums.select("__slice", *[F.sum(c).over(earlier).alias(f"{c}_before") for c in amounts])
    placed = line.select("__slice", "__side", "__by", "__sign", *[F.sum(c).over(inside).alias(c) for c in amounts]).where("__side = 0")
    placed = placed.join(F.broadcast(offsets), "__slice")  # one row a slice
    signed = lambda c: F.coalesce(F.sum(F.when(F.col("__sign") > 0, F.col(c)).otherwise(-F.col(c))), F.lit(0))
    found = placed.groupBy("__by").agg(*[(signed(c) + signed(f"{c}_before")).alias(c) for c in amounts]).where("__n > 0")
    return found.select("__by.*", F.col("__n").alias("n"), F.when(F.col("__known") > 0, F.col("__sum")).alias("total"))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_at: str, right_at: str, slice_seconds: int = 30 * 86400) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time (left join).

    Both sides are laid on one time line per key, cut into slices: a slice
    sees its own rows and the last right row of the slices before it, so the
    rows of a frequent key spread over as many tasks as it has slices.
    """
    keys = list(keys)
    payload = [c for c in right.columns if c not in keys]
    seconds = lambda name: F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(name).cast("timestamp_ntz"))
    l = left.select(
        *[col(k) for k in keys],
        F.col(left_at).alias("__t"),
        F.lit(1).alias("__side"),
        F.struct(*[col(c) for c in left.columns]).alias("__l"),
        F.floor(seconds(left_at) / slice_seconds).alias("__slice"),
    )
    r = right.select(
        *[col(k) for k in keys],
        F.col(right_at).alias("__t"),
        F.lit(0).alias("__side"),
        F.struct(*[col(c) for c in payload]).alias("__r"),
        F.floor(seconds(right_at) / slice_seconds).alias("__slice"),
    )
    line = l.unionByName(r, allowMissingColumns=True)
    inside = Window.partitionBy(*keys, "__slice").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    matched = line.withColumn("__m", F.last("__r", ignorenulls=True).over(inside)).where("__side = 1")
    # one row per key and slice
    slices = line.groupBy(*keys, "__slice").agg(F.max_by("__r", F.when(F.col("__side") == 0, F.struct("__t", "__r"))).alias("__last"))
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("__carry", F.last("__last", ignorenulls=True).over(earlier)).drop("__last")
    out = matched.join(carried, [*keys, "__slice"], "left").withColumn("__m", F.coalesce("__m", "__carry"))
    return out.select("__l.*", *[F.col("__m")[c].alias(c) for c in payload])


def hash_sample(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 42) -> DataFrame:
    """A repeatable row sample: keeps a row when the hash of its key falls below the fraction."""
    bucket = F.pmod(F.xxhash64(*[col(k) for k in keys], F.lit(seed)), F.lit(1_000_000))
    return df.where(bucket < int(fraction * 1_000_000))
