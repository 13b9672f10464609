"""I-Match fingerprints over several randomised lexicon subsets.

Terms are lower-cased words. The lexicon holds the terms whose document
frequency lies in a band; a document keeps its distinct lexicon terms, sorted,
and one hash is taken of those that fall into each random subset of the
lexicon. Subsets thin out in steps of two, so that short and long texts alike
have subsets that hold a term or two, and an edit spares some of them.
DataFrame functions only.

A term in the band occurs in at least `low` of all documents, so there are at
most (mean distinct terms of a document) / low of them, whatever the corpus
size; only the lexicon is broadcast.

Defined cases: a null text is the empty text; a text without lexicon terms has
one hash of the whole text and is like its equals only; rows with the same
doc_id and text are one document; documents without doc_id come first, those
with the same doc_id by the hash of their text; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import slices, text_of, words_of

LOW, HIGH = 0.001, 0.02  # band of the document frequency
LEVELS, COPIES = 8, 3  # subsets of 1/8, 1/16, ... 1/1024 of the lexicon, of each so many
KEY = ["known", "id", "hash"]


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """(known, id, hash, t): a key without nulls, in the order of doc_ids."""
    t = text_of(text)
    i = F.col("doc_id").cast("long")
    return docs.select(i.isNotNull().alias("known"), F.coalesce(i, F.lit(0)).alias("id"), F.xxhash64(t).alias("hash"), t.alias("t"))


def terms_of(text: Column) -> Column:
    """64-bit hashes of the distinct lower-cased words."""
    return F.array_distinct(F.transform(words_of(F.lower(text)), lambda w: F.xxhash64(w)))


def lexicon(texts: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term): the terms that occur in at least `low`, at least two, and at most `high` of the texts in column t."""
    n = texts.count()
    found = texts.select(F.explode(terms_of(F.col("t"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return found.where((F.col("df") >= max(2.0, low * n)) & (F.col("df") <= max(2.0, high * n))).select("term")


def codes_of(terms: Column) -> Column:
    """The hash of each subset's terms, null where it holds none; `terms` are sorted."""
    codes = []
    for k in range(LEVELS * COPIES):
        own = F.filter(terms, lambda x: F.xxhash64(x, F.lit(k)).bitwiseAND(F.lit((8 << k // COPIES) - 1)) == 0)
        codes.append(F.when(F.size(own) > 0, F.substring(F.lpad(F.lower(F.hex(F.xxhash64(own))), 16, "0"), 1, 8)))
    return F.array(*codes)


def fingerprints(versions: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """(key, terms): the sorted lexicon terms of each text that has any; `versions` has the key and column t."""
    each = versions.select(*key, F.explode(terms_of(F.col("t"))).alias("term")).join(F.broadcast(words), "term")
    return each.groupBy(*key).agg(F.array_sort(F.collect_set("term")).alias("terms"))


def written(codes: Column, text_hash: Column) -> Column:
    """The fingerprint as text; a document without terms has its own hash instead."""
    whole = F.concat(F.lit("text:"), F.lower(F.hex(text_hash)))
    return F.when(F.exists(codes, lambda c: c.isNotNull()), F.array_join(codes, ".", "-")).otherwise(whole)


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Share of subsets with equal hashes among those that hold a term of either; without any, equality of the texts."""
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), lambda x: x.isNotNull()))
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x))
    return F.when(either > 0, equal / either).otherwise(same.cast("double"))


def following(keys: DataFrame) -> DataFrame:
    """The key rows with `next`, the key of the next document; after the last comes the first."""
    cut = slices(keys, *KEY)
    own = F.struct(*KEY)
    inside = F.lead(own).over(Window.partitionBy("slice").orderBy(*KEY))
    firsts = cut.groupBy("slice").agg(F.min(own).alias("first"))  # one row a slice
    order = Window.partitionBy(F.lit(0)).orderBy("slice")
    around = F.coalesce(F.lead("first").over(order), F.first("first").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    edge = firsts.select("slice", around.alias("edge"))
    return cut.withColumn("next", inside).join(F.broadcast(edge), "slice").withColumn("next", F.coalesce("next", "edge")).drop("slice", "edge")


def edited_pairs(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: key, t, edited, next; edited ends as the next document begins."""
    body = keyed(docs, text)
    keys = body.withColumn("n", F.length("t")).select(*KEY, "n").distinct()
    ahead = following(keys)
    need = ahead.select(
        *[F.col(f"next.{c}").alias(c) for c in KEY], *[F.col(c).alias(f"_{c}") for c in KEY], F.floor(F.col("n") / 2).cast("int").alias("take"), F.col("next")
    )
    heads = (
        body.join(need, KEY)
        .select(*[F.col(f"_{c}").alias(c) for c in KEY], F.expr("substring(t, 1, take)").alias("head"), "next", "take")
        .groupBy(*KEY)
        .agg(F.any_value("head").alias("head"), F.any_value("next").alias("next"), F.any_value("take").alias("take"))
    )
    kept = F.expr("substring(t, 1, length(t) - take)")
    return body.join(heads, KEY).select(*KEY, "t", F.concat(kept, "head").alias("edited"), "next")


def compare(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document."""
    words = lexicon(keyed(docs, text), low, high)
    pairs = edited_pairs(docs, text)
    both = F.explode(F.array(F.struct(F.lit(0).alias("version"), F.col("t")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("t"))))
    held = fingerprints(pairs.select(*KEY, both.alias("v")).select(*KEY, "v.version", "v.t"), words, [*KEY, "version"])
    of = lambda version: F.max(F.when(F.col("version") == version, F.col("codes")))
    codes = held.withColumn("codes", codes_of(F.col("terms"))).groupBy(*KEY).agg(of(0).alias("own"), of(1).alias("changed"))
    facts = pairs.select(*KEY, "next", F.length("t").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("edited").alias("edited_hash"))
    facts = facts.groupBy(*facts.columns).agg(F.count(F.lit(1)).alias("copies"))
    none = F.array_repeat(F.lit(None).cast("string"), LEVELS * COPIES)
    marked = facts.join(codes, KEY, "left").withColumns({"own": F.coalesce("own", none), "changed": F.coalesce("changed", none)})
    ahead = codes.select(*[F.col(c).alias(f"_{c}") for c in KEY], F.col("own").alias("beyond"))
    is_next = (F.col("next.known") == F.col("_known")) & (F.col("next.id") == F.col("_id")) & (F.col("next.hash") == F.col("_hash"))
    marked = marked.join(ahead, is_next, "left").withColumn("beyond", F.coalesce("beyond", none))
    marked = marked.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))  # repeated rows come out repeatedly
    return marked.select(
        F.when(F.col("known"), F.col("id")).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        written(F.col("own"), F.col("hash")).alias("fingerprint"),
        written(F.col("changed"), F.col("edited_hash")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed"), F.col("hash") == F.col("edited_hash")).alias("near_edited"),
        likeness(F.col("own"), F.col("beyond"), F.col("hash") == F.col("next.hash")).alias("near_next"),
    )
