import random

from pyspark.sql import functions as F

from tabsight.llm import queries, revisit

SCHEMA = "record_id long, url string, captured_at long, kind string, etag string, last_modified string, headers map<string,string>, payload string, page string, own string"


def records(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_canonical_urls(spark):
    urls = {
        "HTTP://User@WWW.Example.com:80/A/b/?utm_source=q&z=1&a=2#frag": "example.com/A/b?a=2&z=1",
        "https://m.example.com/A/b?a=2&z=1&ref=x": "example.com/A/b?a=2&z=1",
        "example.com": "example.com",
        "http://example.com/": "example.com",
        "https://example.com?x": "example.com?x",
    }
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", revisit.canonical_url(F.col("u")).alias("c"))
    assert {r.u: r.c for r in df.collect()} == urls


def brute(rows):
    out = {}
    key = lambda r: (r[2] is not None, r[2] or 0, r[0] is not None, r[0] or 0)
    for r in rows:
        if r[3] != "revisit":
            out[r[0]] = ("full", None, r[7])
            continue
        earlier = [x for x in rows if x[3] == "response" and x[1] == r[1] and r[1] is not None and key(x) < key(r)]
        last = max(earlier, key=key, default=None)
        if last is None:
            out[r[0]] = ("no_earlier_response", None, None)
        elif r[4].removeprefix("W/") == last[4].removeprefix("W/") if r[4] and last[4] else r[5] is not None and r[5] == last[5]:
            out[r[0]] = ("resolved", last[0], last[7])
        else:
            out[r[0]] = ("validator_mismatch", None, None)
    return out


def test_equals_a_plain_search(spark):
    """A third of all captures have one URL; few tags, so that all outcomes occur."""
    rng = random.Random(4)
    rows = []
    for i in range(600):
        url = "h.example/hot" if rng.random() < 0.4 else f"h.example/{rng.randrange(60)}"
        kind = rng.choice(["response", "revisit", "revisit"])
        rows.append((i, url if rng.random() < 0.95 else None, rng.randrange(300), kind, rng.choice(['"a"', 'W/"a"', '"b"', None]), rng.choice(["d1", "d2", None]), {"ETag": "e"}, f"p{i}" if kind == "response" else None))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = {r.record_id: (r.status, r.refers_to, r.payload) for r in revisit.resolve(records(spark, rows).repartition(5)).collect()}
    assert got == brute(rows)
    assert {s for s, _, _ in got.values()} == {"full", "resolved", "validator_mismatch", "no_earlier_response"}


def test_headers_are_merged(spark):
    rows = [
        (1, "http://a.b/c", 1, "response", '"t"', None, {"Content-Type": "text/html", "ETag": '"t"', "Age": "1", "age": "2"}, "body"),
        (2, "https://www.a.b/c/", 2, "revisit", '"t"', None, {"content-type": "x/y", "AGE": "9", "Date": "now"}, None),
        (3, "https://a.b/c", 3, "revisit", '"u"', None, None, None),
    ]
    got = {r.record_id: r for r in revisit.resolve(records(spark, rows)).collect()}
    assert got[2].headers == {"content-type": "text/html", "etag": '"t"', "age": "9", "date": "now"} and got[2].payload == "body"
    assert got[3].status == "validator_mismatch" and got[3].headers == {} and got[3].payload is None


def test_nulls_repeated_rows_and_empty_table(spark):
    nulls = (None,) * 8
    rows = [nulls, nulls, (1, "a.b", None, "response", "e", None, None, "p"), (1, "a.b", None, "response", "e", None, None, "p"), (2, "a.b", 5, "revisit", "e", None, {}, None), (2, "a.b", 5, "revisit", "e", None, {}, None)]
    got = sorted(((r.record_id, r.status, r.payload) for r in revisit.resolve(records(spark, rows)).collect()), key=repr)
    assert got == sorted([(None, "full", None)] * 2 + [(1, "full", "p")] * 2 + [(2, "resolved", "p")] * 2, key=repr)
    assert revisit.resolve(records(spark, [])).count() == 0


def test_own_payloads_and_repeated_record_ids(spark):
    rows = [
        (5, "a.b/1", 1, "response", '"t"', None, {}, "first page"), (5, "a.b/2", 1, "response", '"u"', None, {}, "second page"),
        (None, "a.b/3", 1, "response", '"v"', None, {}, "no id"), (6, "a.b/2", 2, "revisit", '"u"', None, {}, None), (7, "a.b/3", 2, "revisit", '"v"', None, {}, None),
        (5, "a.b/1", 3, "response", '"t"', None, {}, "later"), (8, "a.b/1", 2, "revisit", '"t"', None, {}, None), (9, "a.b/1", 4, "revisit", '"t"', None, {}, None),
    ]
    got = sorted(((r.record_id, r.status, r.payload) for r in revisit.resolve(records(spark, rows)).collect()), key=repr)
    want = [(5, "full", "first page"), (5, "full", "second page"), (None, "full", "no id"), (6, "resolved", "second page"), (7, "no_earlier_response", None)]
    want += [(5, "full", "later"), (8, "resolved", "first page"), (9, "resolved", "later")]
    assert got == sorted(want, key=repr)


def test_the_registered_captures_interleave(spark, sf):
    found = queries.captures(spark.read.parquet(f"{sf}/pages.parquet"))
    page = revisit.canonical_url(F.col("url"))
    pairs = found.select(page.alias("p"), "kind", "captured_at").groupBy("p").agg(F.max(F.when(F.col("kind") == "response", F.col("captured_at"))).alias("a"), F.min(F.when(F.col("kind") == "revisit", F.col("captured_at"))).alias("b"))
    assert pairs.where("a > b").count() > 0
