"""Terms, word counts, lexicon sentiment and number grounding over text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import col
from ..functions.stopwords import ENGLISH, NEGATIONS
from ..session import materialize

TOKEN = r"[\p{L}\p{N}_]{2,}"  # fixed value: two or more word characters
NUMBER_IN_TEXT = r"-?\b\d[\d,]*\.?\d*\b"  # fixed value
COMMON_NUMBERS = (1.0, 2.0, 3.0, 4.0, 5.0, 10.0, 100.0)  # fixed values: never questioned
MOST_AMONG = 1_000  # words up to which pairs are looked for by a list
BROADCAST_TERMS = 100_000


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def content_words(c: Column, stop_words: Sequence[str] = ENGLISH) -> Column:
    """Tokens without stop words, in order."""
    return F.filter(tokens(c), lambda t: ~t.isin(*stop_words)) if stop_words else tokens(c)


def adjacent_pairs(words: Column, among: Sequence[str]) -> Column:
    """Neighbouring words, both among the given ones."""
    pair = lambda w, i: F.when(w.isin(*among) & F.get(words, i + 1).isin(*among), F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return F.array_compact(F.transform(words, pair))


def top_terms(
    df: DataFrame, text: str, key: str, stop_words: Sequence[str] = ENGLISH, vocabulary: int = 30, keep: int = 20, least: int = 5
) -> DataFrame:
    """(term, score): summed TF-IDF weights, each text scaled to length 1.

    Terms are words and pairs of neighbouring words. The vocabulary is the most
    frequent terms (ties by term). A pair is never more frequent than either of
    its words, so only pairs of words as frequent as the last word that could
    make the vocabulary are counted; those are few, unless many counts are equal.
    """
    texts = df.select(col(key).alias("doc"), col(text).alias("text")).where("trim(text) <> ''")
    listed = texts.select("doc", content_words(F.col("text"), stop_words).alias("words"))
    tally = lambda c: listed.select(F.explode(c).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    singles = materialize(tally("words"))
    first = singles.orderBy(F.desc("n"), "term").limit(vocabulary).collect()
    n = texts.count()
    if n < least or not first:
        return df.sparkSession.createDataFrame([], "term string, score double")
    limit = first[-1]["n"] if len(first) == vocabulary else 1
    frequent = singles.where(F.col("n") >= limit).select("term")
    among = [r["term"] for r in frequent.limit(MOST_AMONG + 1).collect()]
    if len(among) <= MOST_AMONG:
        counted = tally(adjacent_pairs(F.col("words"), among))
    else:  # so many words of equal counts stay a table
        both = F.transform("words", lambda w, i: F.struct(w.alias("a"), F.get("words", i + 1).alias("b")))
        found = listed.select(F.explode(both).alias("p")).where("p.b IS NOT NULL").groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))
        for side in ("a", "b"):
            found = found.join(frequent.select(F.col("term").alias(side)), side, "left_semi")
        counted = found.select(F.concat_ws(" ", "a", "b").alias("term"), "n")
    pairs = counted.orderBy(F.desc("n"), "term").limit(vocabulary).collect()
    ranked = sorted([*first, *pairs], key=lambda r: (-r["n"], r["term"]))
    words = [r["term"] for r in ranked[:vocabulary]]
    every = F.concat("words", adjacent_pairs(F.col("words"), [w for t in words if " " in t for w in t.split(" ")] or [""]))
    kept = listed.select("doc", F.explode(F.filter(every, lambda t: t.isin(*words))).alias("term"))
    tf = kept.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = tf.groupBy("term").agg((F.log((1.0 + n) / (1.0 + F.count(F.lit(1)))) + 1.0).alias("idf"))
    weighted = tf.join(F.broadcast(idf), "term").withColumn("w", F.col("tf") * F.col("idf"))  # one row per vocabulary term
    norm = weighted.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(F.struct("term", "w")).alias("ws"))
    unit = norm.select("norm", F.inline("ws")).select("term", (F.col("w") / F.col("norm")).alias("w"))
    scores = unit.groupBy("term").agg(F.sum("w").alias("score"))
    return scores.orderBy(F.desc("score"), "term").limit(keep).select("term", F.round("score", 3).alias("score"))


def word_count(df: DataFrame, text: str) -> DataFrame:
    """One row: texts and their mean number of words."""
    c = F.trim(col(text))
    return df.where(c != "").agg(F.count(F.lit(1)).alias("texts"), F.avg(F.size(F.split(c, r"\s+"))).alias("mean_words"))


def sentiment(df: DataFrame, text: str, key: str, lexicon: DataFrame, negations: Sequence[str] = NEGATIONS) -> DataFrame:
    """(key, hits, valence, compound, label) by a lexicon of (token, valence).

    A negation among the three words before a token turns its valence round.
    The compound score is s / sqrt(s^2 + 15); beyond +-0.05 it is labelled.
    """
    words = df.select(col(key).alias("k"), tokens(col(text)).alias("t"))
    marked = F.transform(
        "t",
        lambda w, i: F.struct(
            w.alias("token"),
            F.exists(F.slice(F.col("t"), F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), lambda x: x.isin(*negations)).alias("turned"),
        ),
    )
    single = lexicon.select("token", F.col("valence").cast("double").alias("valence")).dropna()
    side = F.broadcast(single) if single.count() <= BROADCAST_TERMS else single
    hits = words.select("k", F.inline(marked)).join(side, "token")
    signed = F.when(F.col("turned"), -F.col("valence")).otherwise(F.col("valence"))
    scored = hits.groupBy("k").agg(F.count(F.lit(1)).alias("hits"), F.sum(signed).alias("valence"))
    out = words.select("k").join(scored, "k", "left").na.fill({"hits": 0, "valence": 0.0})
    compound = F.col("valence") / F.sqrt(F.col("valence") * F.col("valence") + 15)
    label = F.when(compound >= 0.05, "positive").when(compound <= -0.05, "negative").otherwise("neutral")
    return out.select(F.col("k").alias(key), "hits", "valence", compound.alias("compound"), label.alias("label"))


def sentiment_summary(scored: DataFrame) -> DataFrame:
    """One row: texts, mean compound and the share of each label in percent."""
    share = lambda name: (100.0 * F.count_if(F.col("label") == name) / F.count(F.lit(1))).alias(f"{name}_pct")
    return scored.agg(
        F.count(F.lit(1)).alias("texts"), F.avg("compound").alias("mean_compound"), share("positive"), share("negative"), share("neutral")
    )


def ungrounded_numbers(texts: DataFrame, text: str, key: str, facts: DataFrame, value: str = "value") -> DataFrame:
    """(key, number, times): numbers in the texts that no fact states, directly or as a percentage.

    Letters are unified first so that word boundaries do not depend on the
    alphabet. Equality is on four decimals, so the match is a plain anti join.
    """
    plain = F.regexp_replace(col(text), r"\p{L}", "x")
    found = texts.select(col(key), F.explode(F.regexp_extract_all(plain, F.lit(NUMBER_IN_TEXT), F.lit(0))).alias("s"))
    digits = F.replace("s", F.lit(","), F.lit("")).try_cast("double")
    numbers = found.select(col(key), digits.alias("number")).where("number is not null")
    numbers = numbers.groupBy(key, "number").agg(F.count(F.lit(1)).alias("times")).withColumn("at", F.round("number", 4))
    numbers = numbers.where(~F.col("at").isin(*COMMON_NUMBERS))
    known = facts.select(F.explode(F.array(F.round(col(value).cast("double"), 4), F.round(col(value).cast("double") * 100, 4))).alias("at")).distinct()
    return numbers.join(known, "at", "left_anti").select(key, "number", "times")
