"""Text queries (I, M4)."""

from pyspark.sql import functions as F

from ..functions.columns import rounded
from ..functions.stopwords import ENGLISH, NEGATIONS
from ..operators import text as op
from ..session import load
from .registry import query

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
_STOP = "[" + ", ".join(f"'{w}'" for w in ENGLISH) + "]"
_WORDS = r"len(regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '))"


def terms_sql(source, key):
    return f"""WITH w AS (SELECT {key} AS doc, list_filter({_TOKENS}, lambda t: NOT list_contains({_STOP}, t)) AS ws FROM {source} WHERE trim(text) <> ''),
    t AS (SELECT doc, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
    v AS (SELECT term FROM t GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 30),
    tf AS (SELECT doc, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM v) GROUP BY 1, 2),
    idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM w)) / (1.0 + count(*))) + 1 AS idf FROM tf GROUP BY 1),
    x AS (SELECT doc, term, tf * idf AS w FROM tf JOIN idf USING (term)), n AS (SELECT doc, sqrt(sum(w * w)) AS n FROM x GROUP BY 1)
    SELECT term, round(sum(w / n), 3) AS score FROM x JOIN n USING (doc) GROUP BY 1 ORDER BY sum(w / n) DESC, term LIMIT 20"""


@query("text_top_terms", terms_sql("documents", "doc_id"))
def _(spark, sf):
    return op.top_terms(load(spark, sf, "documents", spread=True), "text", "doc_id")


@query("text_top_terms_turns", terms_sql("conversations", "conv_id || '-' || turn"))
def _(spark, sf):
    c = load(spark, sf, "conversations", spread=True).select(F.concat_ws("-", "conv_id", "turn").alias("turn_key"), "text")
    return op.top_terms(c, "text", "turn_key")


@query("text_word_count", f"SELECT count(*) AS texts, round(avg({_WORDS}), 6) AS mean_words FROM documents WHERE trim(text) <> ''")
def _(spark, sf):
    return rounded(op.word_count(load(spark, sf, "documents", spread=True), "text"))


def quality_lexicon(spark, sf):
    """Valence of a token: how good the labelled documents holding it are on average."""
    d, l = load(spark, sf, "documents", "labels", spread=True)
    held = d.join(l, "doc_id").select("quality", F.explode(F.array_distinct(op.tokens(F.col("text")))).alias("token"))
    return (
        held.groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("quality").alias("q"))
        .where("n >= 5")
        .select("token", F.round((F.col("q") - 0.8) * 2, 3).alias("valence"))
    )


_NEG = "[" + ", ".join(f"'{w}'" for w in NEGATIONS) + "]"
SENTIMENT_SQL = f"""lex AS (SELECT token, round((avg(quality) - 0.8) * 2, 3) AS valence FROM (
        SELECT quality, unnest(list_distinct({_TOKENS})) AS token FROM documents JOIN labels USING (doc_id)) GROUP BY 1 HAVING count(*) >= 5),
    tk AS (SELECT doc_id, {_TOKENS} AS ts FROM documents), px AS (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM tk),
    hit AS (SELECT doc_id, CASE WHEN list_has_any(ts[greatest(1, i - 3):i - 1], {_NEG}) THEN -valence ELSE valence END AS v FROM px JOIN lex ON lex.token = ts[i]),
    s AS (SELECT doc_id, count(*) AS hits, sum(v) AS v FROM hit GROUP BY 1),
    c AS (SELECT doc_id, coalesce(hits, 0) AS hits, coalesce(v, 0) AS valence, coalesce(v, 0) / sqrt(pow(coalesce(v, 0), 2) + 15) AS compound FROM tk LEFT JOIN s USING (doc_id)),
    l AS (SELECT *, CASE WHEN compound >= 0.05 THEN 'positive' WHEN compound <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM c)"""


@query(
    "text_sentiment",
    f"WITH {SENTIMENT_SQL} SELECT doc_id, hits, round(valence, 4) + 0.0 AS valence, round(compound, 6) + 0.0 AS compound, label FROM l",
)
def _(spark, sf):
    s = op.sentiment(load(spark, sf, "documents", spread=True), "text", "doc_id", quality_lexicon(spark, sf))
    return rounded(s.withColumn("valence", F.round("valence", 4)))


@query(
    "text_sentiment_summary",
    f"""WITH {SENTIMENT_SQL} SELECT count(*) AS texts, round(avg(compound), 6) AS mean_compound,
    round(100.0 * count(*) FILTER (WHERE label = 'positive') / count(*), 6) AS positive_pct,
    round(100.0 * count(*) FILTER (WHERE label = 'negative') / count(*), 6) AS negative_pct,
    round(100.0 * count(*) FILTER (WHERE label = 'neutral') / count(*), 6) AS neutral_pct FROM l""",
)
def _(spark, sf):
    return rounded(op.sentiment_summary(op.sentiment(load(spark, sf, "documents", spread=True), "text", "doc_id", quality_lexicon(spark, sf))))


@query(
    "text_ungrounded_numbers",
    r"""WITH f AS (SELECT n_chars AS v FROM documents UNION ALL SELECT doc_id / 1000.0 FROM documents),
    k AS (SELECT round(CAST(v AS DOUBLE), 4) AS a FROM f UNION SELECT round(CAST(v AS DOUBLE) * 100, 4) FROM f),
    n AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '\p{L}', 'x', 'g'), '-?\b\d[\d,]*\.?\d*\b')) AS s FROM documents),
    m AS (SELECT doc_id, CAST(replace(s, ',', '') AS DOUBLE) AS number FROM n)
    SELECT doc_id, number, count(*) AS times FROM m WHERE round(number, 4) NOT IN (1, 2, 3, 4, 5, 10, 100) AND round(number, 4) NOT IN (SELECT a FROM k) GROUP BY 1, 2""",
)
def _(spark, sf):
    d = load(spark, sf, "documents", spread=True)
    facts = d.select(F.explode(F.array(F.col("n_chars").cast("double"), F.col("doc_id") / 1000.0)).alias("value"))
    return op.ungrounded_numbers(d, "text", "doc_id", facts)
