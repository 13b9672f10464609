import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tabsight.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def pieces(docs):
    return packing.token_pieces(docs, PATH).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("crc"))


def test_pieces_hold_the_tokenizer_s_ids(awkward):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for row in awkward.collect():
        ids = tokenizer.encode(row.text or "", add_special_tokens=False).ids + [packing.END_ID]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want.append((row.doc_id, k // 4096, k, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())))
    got = [tuple(r) for r in pieces(awkward).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_sequences_are_gapless_and_within_capacity(awkward):
    rows = packing.pack(pieces(awkward), part_rows=5).collect()
    assert len(rows) == pieces(awkward).count()
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_exchange_reaches_the_bound(spark):
    sizes = [(i, 1 + (i * 7919) % 900) for i in range(3000)]
    items = spark.createDataFrame(sizes, "doc_id long, length long").repartition(6)
    packed = packing.pack(items, part_rows=300)
    counts = np.bincount([n for _, n in sizes], minlength=4097)
    assert packed.select("sequence_id").distinct().count() <= packing.lower_bound(counts, 4096) + 1


def test_empty_table_and_null_ids(empty):
    assert packing.pack(pieces(empty)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_bound_is_below_the_best_packing(lengths):
    counts = np.bincount(lengths, minlength=41)

    def best(rest, bins):
        if not rest:
            return len(bins)
        found = len(bins) + len(rest)
        for i in range(len(bins)):
            if bins[i] + rest[0] <= 40 and bins[i] not in bins[:i]:
                found = min(found, best(rest[1:], bins[:i] + [bins[i] + rest[0]] + bins[i + 1 :]))
        return min(found, best(rest[1:], bins + [rest[0]])) if len(bins) < bound_or(lengths) else found

    def bound_or(values):
        return packing.best_fit_decreasing(np.array(values), 40)[0].max() + 1

    least = best(sorted(lengths, reverse=True)[:9], [])
    small = np.bincount(sorted(lengths, reverse=True)[:9], minlength=41)
    assert packing.lower_bound(small, 40) <= least
    assert packing.lower_bound(counts, 40) <= bound_or(lengths)


@pytest.mark.parametrize("seed", range(3))
def test_best_fit_never_overfills(seed):
    lengths = np.random.default_rng(seed).integers(1, 4097, 500)
    bins, offsets = packing.best_fit_decreasing(lengths, 4096)
    for b in range(bins.max() + 1):
        order = np.argsort(offsets[bins == b])
        n, o = lengths[bins == b][order], offsets[bins == b][order]
        assert (o == np.append(0, np.cumsum(n)[:-1])).all() and n.sum() <= 4096
