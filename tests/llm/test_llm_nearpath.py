import random
import re

from pyspark.sql import functions as F

from tabsight.llm import nearpath

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4))


def brute(rows):
    """(doc_id, size, smallest doc_id of the component) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 85 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        r = find(k)
        least[r] = min((x for x in (least.get(r), doc) if x is not None), default=None)
    return sorted(((doc, len(sets[k]), least[find(k)]) for k, (doc, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in nearpath.near_duplicates(df).collect()), key=repr)


def test_awkward_documents(awkward):
    assert found(awkward) == brute([(r.doc_id, r.text) for r in awkward.collect()])


def test_large_groups_of_near_copies(spark):
    """More copies than a leaf holds, chains of copies, and a passage that many share."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows, passage = [], [word() for _ in range(150)]
    for group in range(4):
        base = [word() for _ in range(260)]
        for _ in range(45):
            copy = list(base)
            for _ in range(rng.randrange(0, 9)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    chain = [word() for _ in range(300)]
    for _ in range(40):
        chain = list(chain)
        for _ in range(4):
            chain[rng.randrange(len(chain))] = word()
        rows.append(chain)
    rows += [passage + [word() for _ in range(rng.randrange(20, 60))] for _ in range(80)]
    rng.shuffle(rows)
    listed = [(k, " ".join(r)) for k, r in enumerate(rows)]
    docs = spark.createDataFrame(listed, "doc_id long, text string").repartition(4)
    assert found(docs) == brute(listed)


def test_one_of_each_group_stays(awkward, empty):
    kept = nearpath.keep_one(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert 1 in ids and 2 not in ids and 3 not in ids and 7 in ids and 8 not in ids
    assert ids.count(11) <= 1
    assert {4, 5, 6} <= set(ids)
    assert nearpath.keep_one(empty).count() == 0
    assert nearpath.near_duplicates(empty).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.range(200).select(F.lpad(F.col("id").cast("string"), 4, "0").cast("binary").alias("a"), F.lpad((F.col("id") + 1).cast("string"), 4, "0").cast("binary").alias("b"))
    labels = nearpath.components(links).collect()
    assert len(labels) == 201 and {bytes(r.label) for r in labels} == {b"0000"}
