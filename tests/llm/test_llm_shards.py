import random
import zlib
from collections import Counter, defaultdict

import pytest

from tabsight.llm import shards


def least_capacity(sizes, n):
    def need(capacity):
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        return used

    low, high = max(max(sizes), -(-sum(sizes) // n)), sum(sizes)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if need(middle) <= n else (middle + 1, high)
    return low


def check(docs, n):
    rows = docs.collect()
    placed = shards.shard(docs, n).collect()
    assert len(placed) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in placed) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    order = sorted(groups, key=lambda t: min((i is not None, i or 0) for i in groups[t]))
    sizes = [len(groups[t]) * (len(t.encode()) + 8) for t in order]
    full, slots = Counter(), defaultdict(list)
    for r in placed:
        full[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < n
    assert max(full.values()) == least_capacity(sizes, n)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_text = {r.doc_id: r.shard for r in placed if r.doc_id is not None}
    return by_text


@pytest.mark.parametrize("n", [1, 3, 24])
def test_driver_documents(spark, sf, n):
    check(spark.read.parquet(f"{sf}/documents.parquet"), n)


def test_awkward_documents(awkward, empty):
    got = check(awkward, 4)
    assert got[1] == got[2]
    assert shards.shard(empty).count() == 0


def test_a_third_of_all_rows_in_one_group(spark):
    rng = random.Random(5)
    rows = [(i, "copy" * 20) for i in range(300)] + [(300 + i, "t" * rng.randrange(500) + str(i)) for i in range(600)]
    rng.shuffle(rows)
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 8)


def test_finer_listings_agree(spark, monkeypatch):
    monkeypatch.setattr(shards, "LISTED", 4)
    monkeypatch.setattr(shards, "FINER", 3)
    rng = random.Random(6)
    rows = [(i, "t" * rng.randrange(60) + str(i)) for i in range(400)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 7)
