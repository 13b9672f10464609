import hashlib

from tabsight.llm import imatch


def test_edits_and_likeness(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: r for r in imatch.compare(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(rows):
        ahead = rows[(k + 1) % len(rows)]
        n = len(text) // 2
        changed = text[: len(text) - n] + ahead[1][:n]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == next(got[j].fingerprint for j, t in rows if t == text)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert (r.near_next == 1) == (r.fingerprint == got[ahead[0]].fingerprint)
        assert (r.near_edited == 1) == (r.fingerprint == r.edited_fingerprint)
    assert sum(r.near_edited for r in got.values()) > 10 * sum(r.near_next for r in got.values() if r.near_next < 1)


def test_codes_follow_the_kept_terms(spark):
    """The same sorted lexicon terms give the same codes, other terms change only the subsets that hold them."""
    from pyspark.sql import functions as F

    words = spark.range(200).select(F.xxhash64(F.concat(F.lit("w"), F.col("id").cast("string"))).alias("term"))
    texts = [(0, " ".join(f"w{i}" for i in range(40))), (1, " ".join(f"w{i}" for i in reversed(range(40))) + " outside"), (2, " ".join(f"w{i}" for i in range(12, 52)))]
    held = imatch.fingerprints(spark.createDataFrame(texts, "id long, t string"), words, ["id"])
    codes = {r.id: r.c for r in held.select("id", imatch.codes_of(F.col("terms")).alias("c")).collect()}
    assert codes[0] == codes[1] != codes[2]
    assert sum(a == b for a, b in zip(codes[0], codes[2])) >= len(codes[0]) // 4


def test_awkward_documents(awkward, empty):
    want = [(r.doc_id, r.text or "") for r in awkward.collect()]
    rows = imatch.compare(awkward).collect()
    assert sorted((repr(r.doc_id), r.n_chars) for r in rows) == sorted((repr(i), len(t)) for i, t in want)
    by = {r.doc_id: r.fingerprint for r in rows}
    assert by[1] == by[2] and by[4] == by[5] and by[7] != by[13]
    assert imatch.compare(empty).count() == 0


def test_native(awkward):
    plan = imatch.compare(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_rows_come_out_repeatedly(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "other"), (2, "a b c"), (None, None), (None, None)]
    got = imatch.compare(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_chars").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(i, len(t or "")) for i, t in rows], key=repr)
