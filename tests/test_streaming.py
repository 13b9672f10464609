"""Streaming runs give the rows of the batch run."""

import pytest
from pyspark.sql import functions as F

from tabsight.session import load
from tabsight.streaming import events as op

CASES = {
    "sessions": lambda df: op.sessions(df, "user_id", "ts", "value"),
    "incremental_profile": lambda df: op.incremental_profile(df, "ts", columns=["value", "event_type"]),
    "trust_alerts": lambda df: op.trust_alerts(df.withColumn("price", F.col("value") - 30), "ts"),
    "sliding_stats": lambda df: op.sliding_stats(df, "ts", "value", "1 day", "6 hours"),
}


def plain(rows):
    return {tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows}


@pytest.mark.parametrize("name", sorted(CASES))
def test_stream_equals_batch(spark, sf, tmp_path, name):
    source = str(tmp_path / "in")
    events = load(spark, sf, "events")
    # a late marker row far in the future closes every real window
    closing = events.limit(1).withColumn("ts", F.timestamp_add("YEAR", F.lit(1), F.col("ts"))).withColumn("user_id", F.lit(-1).cast("long"))
    events.coalesce(1).write.parquet(source)
    closing.coalesce(1).write.mode("append").parquet(source)
    stream = CASES[name](op.read_stream(spark, source, events.schema))
    out = str(tmp_path / "out")
    op.write_stream(stream, out, str(tmp_path / "cp")).awaitTermination()
    op_result = spark.read.parquet(out)
    batch = CASES[name](events)
    assert plain(op_result.collect()) == plain(batch.collect())
