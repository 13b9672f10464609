import re
from collections import Counter

from tabsight.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    repeated = {k + j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_measures(awkward):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in quality.judge(awkward).collect():
        assert tuple(r[n] for n in names) == brute(r.text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_driver_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    judged = quality.judge(docs).collect()
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text) for r in judged)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r.kept for r in judged if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in judged if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_overlapping_repeats(spark):
    texts = ["a b c d e " * 5, "a a a a a a a a a a", "x a b c d e y z a b c d e q r s t", "a b c d e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_repeat_words for r in quality.judge(docs).collect()} == {i: brute(t)[4] for i, t in enumerate(texts)}


def test_rules_table_and_native(awkward, empty):
    assert quality.judge(empty).count() == 0
    strict = quality.judge(awkward, rules=(("n_words", "<", 10**9, 0),))
    assert strict.where("kept").count() == 0
    plan = quality.judge(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan.split("Physical Plan")[1].replace("Exchange RoundRobin", "")
