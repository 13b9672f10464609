import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tabsight.llm import suffixtree

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(LOWER)) + [None]


def brute_model(texts, p_min, depth):
    """Counts of all runs, then the same tests and discounts run by run."""
    count = Counter()
    for t in texts:
        for n in range(1, depth + 2):
            count.update(tuple(t[i : i + n]) for i in range(len(t) - n + 1))
    total = sum(len(t) for t in texts)
    least = max(2, math.ceil(p_min * total))
    distinct = sum(len(g) == 1 for g in count)
    root = lambda w: (count[(w,)] + 0.5) / (total + 0.5 * (distinct + 1))
    frequent = {g for g, n in count.items() if n >= least and (len(g) > 1 or g != (None,))} | {(None,)}
    kept, spread = {}, {}

    def prob(context, w):
        if not context:
            return root(w)
        context = context[-depth:]
        if context in kept:
            if w in kept[context]:
                return kept[context][w]
            return spread[context] * prob(context[1:], w)
        return prob(context[1:], w)

    for n in range(1, depth + 1):
        found = {}
        for context in [g for g in frequent if len(g) == n and None not in g]:
            after = {g[-1]: count[g] for g in frequent if len(g) == n + 1 and g[:-1] == context}
            if not after:
                continue
            c = count[context]
            own = {w: (k - 0.5) / c for w, k in after.items()}
            parent = {w: prob(context[1:], w) for w in after}
            factor = (1 - sum(own.values())) / (1 - sum(parent.values()))
            gain = sum(k * math.log(own[w] / parent[w]) for w, k in after.items()) + (c - sum(after.values())) * math.log(factor)
            if gain > 0.5 * (len(after) + 1) * math.log(c):
                found[context] = (own, factor)
        for context, (own, factor) in found.items():
            kept[context], spread[context] = own, factor
    return root, prob, count, total


@pytest.mark.parametrize("p_min", [0.002, 0.01])
def test_scores_equal_a_plain_model(spark, sf, p_min):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: tokens(r.text) for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in rows}
    root, prob, count, total = brute_model([t for i, t in rows.items() if not held[i]], p_min, suffixtree.DEPTH)
    scores, tree = suffixtree.score_documents(docs, p_min=p_min)
    assert tree.total == total
    for r in scores.collect():
        t = rows[r.doc_id]
        assert r.held_out == held[r.doc_id] and r.n_tokens == len(t)
        assert r.n_known == sum(count[(w,)] > 0 for w in t)
        assert math.isclose(r.base_score, sum(math.log10(root(w)) for w in t), rel_tol=1e-9)
        assert math.isclose(r.score, sum(math.log10(prob(tuple(t[max(0, k - suffixtree.DEPTH) : k]), w)) for k, w in enumerate(t)), rel_tol=1e-9)


def test_distributions_add_up(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = suffixtree.training(docs).where("not held_out")
    tree = suffixtree.fit(texts, suffixtree.word_counts(texts).cache(), 0.002, 2)
    width, known = tree.end + 1, 10.0**tree.log_base
    for context in np.flatnonzero(tree.retained[0])[:50]:
        at = np.flatnonzero(tree.grams[0] // width == context)
        symbol = tree.grams[0][at] % width
        inside = (known[symbol] * 10.0 ** tree.ratio[0][at]).sum()
        assert math.isclose(inside + (1 - known[symbol].sum()) * 10.0 ** tree.spread[0][context], 1.0, rel_tol=1e-9)


def test_held_out_texts_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scores, _ = suffixtree.score_documents(docs)
    base, own = scores.where("held_out").selectExpr("sum(base_score)", "sum(score)").first()
    assert own > base


def test_awkward_documents(awkward, empty):
    scores, tree = suffixtree.score_documents(awkward, p_min=0.01)
    rows = scores.collect()
    assert len(rows) == awkward.count()
    texts = Counter((r.doc_id, len(tokens(r.text))) for r in awkward.collect())
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == texts
    train = Counter(w for r in awkward.collect() if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 != 1 for w in tokens(r.text))
    want = sorted((r.doc_id or -1, sum(train[w] > 0 for w in tokens(r.text))) for r in awkward.collect())
    assert sorted((r.doc_id or -1, r.n_known) for r in rows) == want
    assert tree.total == sum(train.values())
    none, _ = suffixtree.score_documents(empty)
    assert none.count() == 0


@pytest.mark.parametrize("depth", [2, 3])
def test_all_runs_seen_twice_count(spark, depth):
    """No share of the corpus is asked for: a run seen twice in many texts is a context as in few."""
    rare = ["violet heron crossing quietly", "seldom heard copper bells"]
    rows = [(k, " ".join(f"filler{(k * 7 + j * j) % 97}" for j in range(60 + k % 9)) + (f" {rare[k % 2]}" if k < 8 else "") + (" alone" if k % 50 == 0 else "")) for k in range(900)]
    rows += [(None, rows[3][1]), (None, None), (901, ""), (3, rows[3][1]), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    words = [tokens(t) for _, t in rows]
    root, prob, count, total = brute_model([t for t, h in zip(words, held) if not h], 0.0, depth)
    scores, tree = suffixtree.score_documents(docs, depth=depth)
    assert tree.total == total
    want = []
    for (i, _), h, t in zip(rows, held, words):
        known = sum(count[(w,)] > 0 for w in t)
        log = lambda p: round(sum(map(math.log10, p)), 6) + 0.0
        want.append((i, h, len(t), known, log(map(root, t)), log(prob(tuple(t[max(0, k - depth) : k]), w) for k, w in enumerate(t))))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6) + 0.0, round(r.score, 6) + 0.0) for r in scores.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_a_run_seen_twice_in_a_large_corpus_counts(spark):
    """314,000 training tokens: a share of 1e-5 would ask for four."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    ids = [i for i in range(10**9, 10**9 + 50) if zlib.crc32(str(i).encode()) % 5 != 1][:2]
    probe = next(i for i in range(10**9, 10**9 + 50) if zlib.crc32(str(i).encode()) % 5 == 1)
    phrase = "zqviolet zqheron zqcrossing zqquietly"
    added = spark.createDataFrame([(i, phrase) for i in [*ids, probe]], "doc_id long, text string")
    scores, tree = suffixtree.score_documents(docs.union(added))
    assert tree.total > 300_000
    row = scores.where(f"doc_id = {probe}").first()
    assert row.n_known == 5 and row.score > row.base_score + 8


@pytest.mark.parametrize("depth,part", [(2, 40), (3, 40), (2, 3)])
def test_hot_contexts_are_dealt_by_longer_ones(spark, depth, part):
    """A third of all positions after one word, a pair and a triple seen as often, several blocks: the same scores."""
    rows = [(k, " ".join(["so it goes on" if j % 3 else f"w{(k * j) % 23} so w{(k + j) % 11}" for j in range(4 + k % 5)])) for k in range(90)]
    rows += [(None, "so it goes"), (None, None), (91, ""), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    words = [tokens(t) for _, t in rows]
    root, prob, count, total = brute_model([t for t, h in zip(words, held) if not h], 0.0, depth)
    scores, tree = suffixtree.score_documents(docs, depth=depth, part=part)
    assert len(tree.hot) == depth and tree.total == total
    want = [(i, h, len(t), round(sum(math.log10(prob(tuple(t[max(0, k - depth) : k]), w)) for k, w in enumerate(t)), 6) + 0.0) for (i, _), h, t in zip(rows, held, words)]
    got = [(r.doc_id, r.held_out, r.n_tokens, round(r.score, 6) + 0.0) for r in scores.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
