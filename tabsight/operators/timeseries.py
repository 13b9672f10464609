"""Time series over any number of series at once.

`keys` names the columns that tell series apart; without keys the table is
one series. Row-by-row windows run in chunks of a regular index, so a single
very long series still spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import col, is_temporal, number_of, parse_timestamp, string_columns
from ..session import materialize

CHUNK = 50_000
WEEK, ROLLING = 7, 7
EPOCH = "1970-01-01 00:00:00"
NAME_HINTS = r"(?i)date|time|year|month|day|timestamp"
Z95 = 1.959963984540054  # two-sided 95 % point of the normal distribution


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put per-series numbers on every row; a keyless table reads its one row as a subquery."""
    names = [c for c in stats.columns if c not in keys]
    if keys:
        return df.join(stats, list(keys))
    one = stats.select(F.struct(*names)).scalar()
    return df.withColumn("__s", one).select("*", *[F.col(f"__s.{n}").alias(n) for n in names]).drop("__s")


def moment_of(df: DataFrame, name: str) -> Column:
    return col(name).cast("timestamp_ntz") if is_temporal(df.schema[name]) else parse_timestamp(col(name))


def detect_datetime_column(df: DataFrame) -> DataFrame:
    """(column, reason): typed time columns first, then named ones that parse, then any that parse."""
    spark = df.sparkSession
    typed = [f.name for f in df.schema if is_temporal(f)]
    if typed:
        return spark.createDataFrame([(typed[0], "type")], "column string, reason string")
    texts = string_columns(df)
    if not texts:
        return spark.createDataFrame([], "column string, reason string")
    cells = [F.struct(F.lit(i).alias("pos"), F.lit(n).alias("column"), col(n).alias("v")) for i, n in enumerate(texts)]
    seen = df.select(F.inline(F.array(*cells))).where("trim(v) <> ''").groupBy("pos", "column").agg(
        F.count(F.lit(1)).alias("n"), F.count(parse_timestamp(F.col("v"))).alias("parsed")
    )
    named = F.col("column").rlike(NAME_HINTS)
    good = seen.where("parsed > 0.7 * n").withColumn("rank", F.when(named, 0).otherwise(1))
    return good.orderBy("rank", "pos").limit(1).select("column", F.when(named, "name").otherwise("values").alias("reason"))


def prepare(df: DataFrame, date_col: str, value_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ts, value): valid rows only, the mean per timestamp."""
    rows = df.select(*[col(k) for k in keys], moment_of(df, date_col).alias("ts"), number_of(df, value_col).alias("value"))
    return rows.dropna(subset=["ts", "value"]).groupBy(*keys, "ts").agg(F.avg("value").alias("value"))


def frequency(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, unit, step, lo, hi, size) of each series.

    A series is regular when its distinct timestamps fill an even grid of
    microseconds or calendar months; that shows in its ends, its count and one
    divisibility check, without sorting. Anything else is treated as daily.
    """
    micros = F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col("ts"))
    month = F.year("ts") * 12 + F.month("ts") - 1
    midnight = F.col("ts") == F.date_trunc("day", "ts").cast("timestamp_ntz")
    rows = series.select(
        *keys,
        micros.alias("u"),
        month.cast("long").alias("m"),
        (midnight & (F.dayofmonth("ts") == 1)).alias("first_day"),
        (midnight & (F.to_date("ts") == F.last_day("ts"))).alias("last_day"),
    )
    ends = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("u").alias("lo"),
        F.max("u").alias("hi"),
        F.min("m").alias("mlo"),
        F.max("m").alias("mhi"),
        (F.bool_and("first_day") | F.bool_and("last_day")).alias("monthly"),
    )
    many = F.col("n") > 2
    ends = ends.withColumn("du", F.when(many & ((F.col("hi") - F.col("lo")) % (F.col("n") - 1) == 0), F.floor((F.col("hi") - F.col("lo")) / (F.col("n") - 1))))
    ends = ends.withColumn(
        "dm", F.when(many & F.col("monthly") & ((F.col("mhi") - F.col("mlo")) % (F.col("n") - 1) == 0), F.floor((F.col("mhi") - F.col("mlo")) / (F.col("n") - 1)))
    )
    on_grid = attach(rows, ends.select(*keys, "lo", "mlo", "du", "dm"), keys).groupBy(*keys).agg(
        F.bool_and(F.coalesce(F.expr("(u - lo) % nullif(du, 0) = 0"), F.lit(False))).alias("even_u"),
        F.bool_and(F.coalesce(F.expr("(m - mlo) % nullif(dm, 0) = 0"), F.lit(False))).alias("even_m"),
    )
    by_month = F.col("even_m") & (F.col("dm") > 0)
    by_micro = F.col("even_u") & (F.col("du") > 0)
    out = attach(ends, on_grid, keys)
    day = 86_400_000_000
    return out.select(
        *keys,
        F.when(by_month, "month").when(by_micro, "micro").otherwise("day").alias("unit"),
        F.when(by_month, F.col("dm")).when(by_micro, F.col("du")).otherwise(F.lit(day)).alias("step"),
        "lo",
        F.when(by_month | by_micro, F.col("n")).otherwise(F.floor(F.col("hi") / day) - F.floor(F.col("lo") / day) + 1).alias("size"),
    )


def _time_at(idx: Column) -> Column:
    """Timestamp of a grid index, from the series' unit, step and first moment."""
    start = F.timestamp_add("MICROSECOND", F.col("lo"), F.lit(EPOCH).cast("timestamp_ntz"))
    day = F.date_trunc("day", start).cast("timestamp_ntz")
    months = F.timestamp_add("MONTH", (idx * F.col("step")).cast("int"), start)
    months = F.when(F.to_date(start) == F.last_day(start), F.last_day(months).cast("timestamp_ntz")).otherwise(months)
    return (
        F.when(F.col("unit") == "month", months)
        .when(F.col("unit") == "micro", F.timestamp_add("MICROSECOND", idx * F.col("step"), start))
        .otherwise(F.timestamp_add("DAY", idx.cast("int"), day))
    )


def interpolate(rows: DataFrame, grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Values of (keys, idx) put on the full grid, gaps filled on the straight line between neighbours.

    The grid is one row per calendar day and series, which bounds the window.
    """
    full = grid.join(rows, [*keys, "idx"], "left")
    series = Window.partitionBy(*keys, F.lit(0)).orderBy("idx")
    point = F.when(F.col("value").isNotNull(), F.struct("idx", "value"))
    before = F.last(point, ignorenulls=True).over(series.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, ignorenulls=True).over(series.rowsBetween(0, Window.unboundedFollowing))
    full = full.withColumn("p", before).withColumn("q", after)
    share = F.try_divide((F.col("idx") - F.col("p.idx")).cast("double"), (F.col("q.idx") - F.col("p.idx")).cast("double"))
    value = F.coalesce("value", F.col("p.value") + (F.col("q.value") - F.col("p.value")) * share, "p.value", "q.value")
    return full.withColumn("value", value).drop("p", "q")


def regular_series(df: DataFrame, date_col: str, value_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, idx, ts, value, unit, step, lo, size): one row per grid point, no gaps.

    Written once to the checkpoint folder: every analysis reads it several times.
    """
    series = prepare(df, date_col, value_col, keys)
    freq = frequency(series, keys)
    placed = attach(series, freq, keys)
    micros = F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), F.col("ts"))
    months = F.year("ts") * 12 + F.month("ts")
    start = F.timestamp_add("MICROSECOND", F.col("lo"), F.lit(EPOCH).cast("timestamp_ntz"))
    day = 86_400_000_000
    idx = (
        F.when(F.col("unit") == "month", F.floor((months - (F.year(start) * 12 + F.month(start))) / F.col("step")))
        .when(F.col("unit") == "micro", F.floor((micros - F.col("lo")) / F.col("step")))
        .otherwise(F.floor(micros / day) - F.floor(F.col("lo") / day))
    )
    meta = ["unit", "step", "lo", "size"]
    placed = placed.withColumn("idx", idx.cast("long"))
    even = placed.where("unit <> 'day'").select(*keys, "idx", "value", *meta)
    daily = placed.where("unit = 'day'").groupBy(*keys, "idx").agg(F.avg("value").alias("value"))
    grid = freq.where("unit = 'day'").select(*keys, *meta, F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("idx"))
    filled = interpolate(daily, grid, keys).select(*keys, "idx", "value", *meta)
    return materialize(even.unionByName(filled).withColumn("ts", _time_at(F.col("idx"))))


def rolling(rows: DataFrame, keys: Sequence[str], before: int, after: int, **exprs) -> DataFrame:
    """Window expressions over `before`/`after` neighbours by idx, in chunks with a margin.

    Each expression is a function of the window; rows near a chunk's edge are
    copied to the neighbouring chunk, so no task sees a whole long series.
    """
    spread = rows.withColumn(
        "chunk",
        F.explode(F.sequence(F.floor((F.col("idx") - after) / CHUNK), F.floor((F.col("idx") + before) / CHUNK))),
    )
    w = Window.partitionBy(*keys, "chunk").orderBy("idx")
    out = spread.select("*", *[make(w).alias(name) for name, make in exprs.items()])
    return out.where(F.floor(F.col("idx") / CHUNK) == F.col("chunk")).drop("chunk")


def seasonal_period() -> Column:
    """Length of a season from the grid step; shortened when fewer than two seasons are seen."""
    hour, day = 3_600_000_000, 86_400_000_000
    unit, step = F.col("unit"), F.col("step")
    period = (
        F.when((unit == "month") & (step == 1), 12)
        .when((unit == "month") & (step == 3), 4)
        .when((unit == "micro") & (step == 7 * day), 52)
        .when((unit == "micro") & (step == hour), 24)
        .otherwise(WEEK)
    )
    return F.when(F.col("size") <= 2 * period, F.greatest(F.lit(2), F.floor(F.col("size") / 2))).otherwise(period).cast("int")


def rolling_stats(rows: DataFrame, keys: Sequence[str] = (), window: int = ROLLING) -> DataFrame:
    """Add trailing mean and deviation; a short series uses half its length."""
    width = F.when(F.col("size") < window, F.greatest(F.lit(2), F.floor(F.col("size") / 2))).otherwise(window)
    recent = lambda w: F.collect_list("value").over(w.rowsBetween(-(window - 1), 0))  # noqa: E731  at most `window` values
    out = rolling(rows, keys, window - 1, 0, recent=recent)
    out = out.withColumn("recent", F.slice("recent", F.greatest(F.lit(1), F.size("recent") - width.cast("int") + 1), width.cast("int")))
    n = F.size("recent")
    mean = F.aggregate("recent", F.lit(0.0), lambda a, x: a + x) / n
    out = out.withColumn("rolling_mean", mean)
    squares = F.aggregate("recent", F.lit(0.0), lambda a, x: a + (x - F.col("rolling_mean")) * (x - F.col("rolling_mean")))
    return out.withColumn("rolling_std", F.when(n > 1, F.sqrt(squares / F.greatest(n - 1, F.lit(1)))).otherwise(F.lit(0.0))).drop("recent")


def _line(rows: DataFrame, keys, where: Column, slope: str, base: str) -> DataFrame:
    """Least-squares line of trend over idx on the chosen rows, per series."""
    x, y = F.when(where, F.col("idx").cast("double")), F.when(where, F.col("trend"))
    return rows.groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.covar_pop(x, y), F.var_pop(F.when(y.isNotNull(), x))), F.lit(0.0)).alias(slope),
        F.avg(F.when(y.isNotNull(), x)).alias(f"{base}_x"),
        F.avg(y).alias(base),
    )


def decompose(df: DataFrame, date_col: str, value_col: str, keys: Sequence[str] = (), max_period: int = 52) -> DataFrame:
    """(keys, idx, ts, observed, trend, seasonal, residual, rolling_mean, rolling_std), additive.

    The trend is a centred moving average of one season (end weights halved
    for an even season), continued at both ends by the line through the
    nearest season of trend points.
    """
    rows = regular_series(df, date_col, value_col, keys).withColumn("period", seasonal_period())
    half = max_period // 2
    around = lambda w: F.collect_list(F.struct("idx", "value")).over(w.rowsBetween(-half, half))  # noqa: E731  at most max_period + 1
    rows = rolling(rows, keys, half, half, around=around)
    h = F.floor(F.col("period") / 2)
    even = F.col("period") % 2 == 0
    inside = (F.col("idx") >= h) & (F.col("idx") <= F.col("size") - 1 - h)

    def weighted(acc, p):
        distance = F.abs(p["idx"] - F.col("idx"))
        weight = F.when(distance > h, 0.0).when(even & (distance == h), 0.5).otherwise(1.0)
        return acc + weight * p["value"]

    trend = F.when(inside, F.aggregate("around", F.lit(0.0), weighted) / F.col("period"))
    rows = materialize(rows.withColumn("trend", trend).drop("around"))
    first = (F.col("idx") >= h) & (F.col("idx") < h + F.col("period"))
    last = (F.col("idx") <= F.col("size") - 1 - h) & (F.col("idx") > F.col("size") - 1 - h - F.col("period"))
    rows = attach(rows, _line(rows, keys, first, "s1", "b1"), keys)
    rows = attach(rows, _line(rows, keys, last, "s2", "b2"), keys)
    edge = F.when(F.col("idx") < h, F.col("b1") + F.col("s1") * (F.col("idx") - F.col("b1_x"))).otherwise(
        F.col("b2") + F.col("s2") * (F.col("idx") - F.col("b2_x"))
    )
    rows = rows.withColumn("trend", F.coalesce("trend", edge)).withColumn("phase", F.col("idx") % F.col("period"))
    phases = rows.groupBy(*keys, "phase").agg(F.avg(F.col("value") - F.col("trend")).alias("phase_mean"))
    centre = phases.groupBy(*keys).agg(F.avg("phase_mean").alias("centre"))
    phases = attach(phases, centre, keys).select(*keys, "phase", (F.col("phase_mean") - F.col("centre")).alias("seasonal"))
    rows = rolling_stats(rows.drop("s1", "b1", "b1_x", "s2", "b2", "b2_x"), keys)
    rows = rows.join(F.broadcast(phases) if not keys else phases, [*keys, "phase"])  # one season of rows per series
    return rows.select(
        *keys,
        "idx",
        "ts",
        F.col("value").alias("observed"),
        "trend",
        "seasonal",
        (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"),
        "rolling_mean",
        "rolling_std",
    )


def forecast_ar(df: DataFrame, date_col: str, value_col: str, periods: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, step_ahead, ts, forecast, lower, upper): first-order autoregression of the differences.

    The coefficient and noise are sums over the series; fewer than four points
    give the last value with a 10 % band.
    """
    rows = regular_series(df, date_col, value_col, keys)
    lags = rolling(rows, keys, 2, 0, y1=lambda w: F.lag("value", 1).over(w), y2=lambda w: F.lag("value", 2).over(w))
    lags = lags.withColumn("d", F.when(F.col("idx") >= 1, F.col("value") - F.col("y1")))
    lags = lags.withColumn("d1", F.when(F.col("idx") >= 2, F.col("y1") - F.col("y2")))
    phi = F.coalesce(F.try_divide(F.sum(F.col("d") * F.col("d1")), F.sum(F.when(F.col("d").isNotNull(), F.col("d1") * F.col("d1")))), F.lit(0.0))
    fit = lags.groupBy(*keys, "unit", "step", "lo", "size").agg(
        F.least(F.greatest(phi, F.lit(-0.99)), F.lit(0.99)).alias("phi"),
        F.max_by("value", "idx").alias("last"),
        F.max_by("d", "idx").alias("last_d"),
    )
    noise = attach(lags, fit.select(*keys, "phi"), keys).groupBy(*keys).agg(
        F.avg(F.pow(F.col("d") - F.col("phi") * F.col("d1"), 2)).alias("s2")
    )
    ahead = attach(fit, noise, keys).withColumn("step_ahead", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    h, p = F.col("step_ahead"), F.col("phi")
    mean = F.col("last") + F.col("last_d") * p * (1 - F.pow(p, h)) / (1 - p)
    spread = F.aggregate(
        F.sequence(F.lit(1), h), F.lit(0.0), lambda a, j: a + F.pow((1 - F.pow(F.col("phi"), j)) / (1 - F.col("phi")), 2.0)
    )
    band = F.lit(Z95) * F.sqrt(F.col("s2") * spread)
    enough = F.col("size") >= 4
    return ahead.select(
        *keys,
        "step_ahead",
        _time_at(F.col("size") - 1 + h).alias("ts"),
        F.when(enough, mean).otherwise(F.col("last")).alias("forecast"),
        F.when(enough, mean - band).otherwise(F.col("last") * 0.9).alias("lower"),
        F.when(enough, mean + band).otherwise(F.col("last") * 1.1).alias("upper"),
    )


def forecast_seasonal(df: DataFrame, date_col: str, value_col: str, periods: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, step_ahead, ts, forecast, lower, upper): line plus weekday and, past a year, month effects."""
    rows = regular_series(df, date_col, value_col, keys)
    x, y = F.col("idx").cast("double"), F.col("value")
    fit = rows.groupBy(*keys, "unit", "step", "lo", "size").agg(
        F.coalesce(F.try_divide(F.covar_pop(x, y), F.var_pop(x)), F.lit(0.0)).alias("slope"), F.avg(x).alias("mx"), F.avg(y).alias("my")
    )
    line = F.col("my") + F.col("slope") * (F.col("idx") - F.col("mx"))
    rows = attach(rows, fit.select(*keys, "slope", "mx", "my"), keys).select(
        *keys, "size", (F.col("value") - line).alias("r"), F.dayofweek("ts").alias("dow"), F.month("ts").alias("mon")
    )
    weekly = rows.where("size > 14").groupBy(*keys, "dow").agg(F.avg("r").alias("w"))
    rows = rows.join(weekly, [*keys, "dow"], "left").withColumn("r", F.col("r") - F.coalesce("w", F.lit(0.0)))
    yearly = rows.where("size > 365").groupBy(*keys, "mon").agg(F.avg("r").alias("m"))
    rows = rows.join(yearly, [*keys, "mon"], "left").withColumn("r", F.col("r") - F.coalesce("m", F.lit(0.0)))
    noise = rows.groupBy(*keys).agg(F.stddev_pop("r").alias("s"))
    ahead = attach(fit, noise, keys).withColumn("step_ahead", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    ahead = ahead.withColumn("idx", F.col("size") - 1 + F.col("step_ahead")).withColumn("ts", _time_at(F.col("idx")))
    ahead = ahead.withColumn("dow", F.dayofweek("ts")).withColumn("mon", F.month("ts"))
    ahead = ahead.join(weekly, [*keys, "dow"], "left").join(yearly, [*keys, "mon"], "left")
    value = line + F.coalesce("w", F.lit(0.0)) + F.coalesce("m", F.lit(0.0))
    band = F.lit(Z95) * F.col("s")
    return ahead.select(
        *keys, "step_ahead", "ts", value.alias("forecast"), (value - band).alias("lower"), (value + band).alias("upper")
    )


def history_and_forecast(history: DataFrame, forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One series of observed and forecast points; the forecast starts at the last observed value."""
    last = history.groupBy(*keys).agg(F.max_by("value", "ts").alias("last"))
    joined = attach(forecast, last, keys)
    past = history.select(*keys, "ts", F.col("value").alias("observed"))
    start = F.when(F.col("step_ahead") == 1, F.col("last"))
    future = joined.select(*keys, "ts", start.alias("observed"), F.coalesce(start, "forecast").alias("forecast"), "lower", "upper")
    return past.unionByName(future, allowMissingColumns=True)
