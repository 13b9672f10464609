"""The whole pipeline and the registered queries of the subpackage."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from compare import compare, oracle_connection
from tabsight.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_all_are_registered():
    names = set(queries.QUERIES)
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)}
    assert names | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, name):
    assert compare(spark, oracle_connection(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_one_row_per_document_or_piece(spark, name):
    rows = queries.QUERIES[name](spark, SF).count()
    docs = spark.read.parquet(f"{SF}/{'pages' if name.startswith('op11_') else 'documents'}.parquet").count()
    assert rows >= docs if name.startswith("op1_") else rows == docs


def test_stages_keep_columns_and_take_effect(awkward):
    spark = awkward.sparkSession
    docs, seen = awkward, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SF))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == COLUMNS
    ids = lambda name: [r.doc_id for r in seen[name].collect()]
    assert not {4, 5, 6, 7, 8, 17} & {i for i in ids("quality rules") if i != 17}
    assert "eighteen" not in {r.doc_id: r.text for r in seen["line dedup"].collect()}.get(11, "")
    assert 2 not in ids("near dedup") and 1 in ids("near dedup")
    assert sorted({r.doc_id for r in docs.collect()}, key=repr) == sorted(set(ids("secret scans")), key=repr)


def test_empty_table(empty):
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(empty.sparkSession, docs, SF))
    assert docs.count() == 0


def test_run(spark):
    plan = corpus_pipeline.run(spark, SF)
    kept = corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert 0 < plan.select("doc_id").distinct().count() <= kept.count()


def test_near_dedup_links_from_four_fifths(spark):
    """Pairs with 0.80 to 0.85 of their shingles in common leave one document; pairs below leave both."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    rows, near, far = [], [], []
    while len(near) < 60 or len(far) < 20:
        a = [word() for _ in range(200)]
        b = list(a)
        for k in rng.sample(range(5, 195), 4 + len(rows) % 3):
            b[k] = word()
        similarity = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
        group = near if 0.8 <= similarity < 0.85 else far if similarity < 0.79 else None
        if group is not None:
            group.append(len(rows))
            rows += [(len(rows) + k, " ".join(w), "en", "s", 1) for k, w in enumerate((a, b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    ids = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert {k for k in far} | {k + 1 for k in far} <= ids and set(near) <= ids
    assert sum(k + 1 in ids for k in near) <= 1
