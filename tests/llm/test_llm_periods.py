import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tabsight.llm import periods, queries

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, 2 * q) and not any(all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def coded(words):
    numbers = {}
    return np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=20), st.integers(1, 5)), max_size=8))
def test_runs_equal_brute_force(parts):
    words = [w for part, times in parts for w in part * times]
    assert periods.runs_of(coded(words)) == brute(words)


@pytest.mark.parametrize("letters", [1, 2, 3])
def test_crossing_runs(letters):
    rng = random.Random(letters)
    for n in (11, 12, 13, 40, 257):
        words = [rng.randrange(letters) for _ in range(n)]
        assert periods.runs_of(coded(words)) == brute(words)
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a  # each run within longer ones
    assert periods.runs_of(coded(b)) == brute(b)


def test_transform_is_exact():
    rng = np.random.default_rng(3)
    x, y = (rng.integers(0, periods.PRIME, (3, 32)).astype(np.uint64) for _ in range(2))
    product = periods.back(periods.transform(x) * periods.transform(y) % periods.MODULUS)
    for r in range(3):
        plain = [sum(int(x[r, i]) * int(y[r, (k - i) % 32]) for i in range(32)) % periods.PRIME for k in range(32)]
        assert product[r].tolist() == plain


def test_wide_blocks_are_cut(monkeypatch):
    words = list(range(300)) * 2 + [7] * 30
    expected = periods.runs_of(coded(words))
    monkeypatch.setattr(periods, "WIDEST", 16)
    assert periods.runs_of(coded(words)) == expected == brute(words)


def test_long_texts_are_quick():
    import time

    start = time.perf_counter()
    for words in ([0] * 300_000, list(range(100_000)) * 3, [k % 997 for k in range(300_000)]):
        assert len(periods.runs_of(np.array(words))) == 1
    assert time.perf_counter() - start < 30


def test_awkward_documents(awkward):
    found = periods.collapse(awkward)
    assert found.columns == [c for c in awkward.columns if c != "n_words"] + ["n_words", "runs", "collapsed"]
    rows = found.collect()
    assert len(rows) == awkward.count()
    for r in rows:
        words = (r.text or "").encode().split()
        expected = brute(words[:400]) if len(words) < 400 else None
        if expected is not None:
            assert [tuple(x) for x in r.runs] == expected
        assert r.n_words == len(words)
    the = next(r for r in rows if r.doc_id == 17 and r.text.startswith("the the"))
    assert len(the.text.split()) < 12 and the.collapsed == the.text or the.collapsed == "the"
    long = next(r for r in rows if r.doc_id == 14)
    assert [tuple(x) for x in long.runs] == [(0, 20000, 9000)] and len(long.collapsed.split()) == 9000


def test_registered_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op12_block_convolution_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    planted = 0
    for doc_id, text in docs:
        words = (text or "").encode().split()
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            planted += 1
        elif n > 700:
            continue
        r = got[doc_id]
        runs = brute(words) if n <= 700 else [(x, y, z) for x, y, z in periods.runs_of(coded(words))]
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
    assert planted > 5


def test_empty_table(empty):
    assert periods.collapse(empty).count() == 0
    assert periods.with_planted_period(empty).count() == 0


def test_null_id(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (5, "")], "doc_id long, text string")
    assert [tuple(r) for r in periods.with_planted_period(df).collect()] == [(None, "a b"), (None, None), (5, "")]
