"""Quality rules: a threshold table compiled into one projection.

The measures are column expressions over the whole text; the table below
names one, a comparison and a bound per rule. No user functions are involved.

Defined cases: null and empty texts have all counts 0 and fail the base rule;
equal rows give equal results; extra columns pass through untouched, and a
column that has the name of a measure is replaced; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of, words_of

WINDOW = 5

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for with as on be at by this are from or an "
    "le la les de des du et en un une que qui est dans pour sur pas "
    "der die das und zu den von mit ist nicht ein eine im auf sich "
    "el los las y se del una por con para como al no su o"
).split()

# (measure, fails if it is, bound, words from which the rule holds). Ratios of an
# empty denominator are null and never fail; short texts say too little for most rules.
Rule = tuple[str, str, float, int]
RULES: tuple[Rule, ...] = (
    ("mean_word_length", "<", 2.0, 20),
    ("mean_word_length", ">", 16.0, 20),
    ("symbol_ratio", ">", 0.3, 1),
    ("stop_words", "<", 2, 25),
    ("dup_line_ratio", ">", 0.5, 20),
    ("alpha_ratio", "<", 0.6, 20),
)


MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "mean_word_length", "symbol_ratio", "stop_words", "dup_line_ratio", "alpha_ratio",
)


def _add(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts and ratios of each text.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and of them
    mean_word_length, symbol_ratio, stop_words (distinct), dup_line_ratio,
    alpha_ratio (letters among the characters of words).
    """
    df = _add(docs, _t=text_of(text))
    df = _add(df, _w=words_of(F.col("_t")), _l=F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"\S")))
    n = F.size("_w")
    window = F.transform(
        F.sequence(F.lit(1), n - (WINDOW - 1)),
        lambda i: F.xxhash64(*[F.element_at("_w", (i + k).cast("int")) for k in range(WINDOW)]),
    )
    df = _add(
        df,
        n_words=n.cast("long"),
        word_chars=F.length(F.array_join("_w", "")).cast("long"),
        n_symbols=(F.length("_t") - F.length(F.regexp_replace("_t", r"[#*$%&|<>]+", ""))).cast("long"),
        n_dup_lines=(F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
        _h=F.when(n > WINDOW, window).otherwise(F.array().cast("array<bigint>")),
    )
    df = _add(df, n_repeat_words=_repeat_words(F.col("_h")))
    words = F.nullif(F.col("n_words"), F.lit(0))
    letters = F.length(F.regexp_replace("_t", r"[\s\p{L}]+", ""))
    df = _add(
        df,
        mean_word_length=F.col("word_chars") / words,
        symbol_ratio=F.col("n_symbols") / words,
        stop_words=F.size(F.array_intersect(F.transform(F.array_distinct("_w"), F.lower), F.array(*map(F.lit, STOP_WORDS)))),
        dup_line_ratio=F.col("n_dup_lines") / F.nullif(F.size("_l"), F.lit(0)),
        alpha_ratio=1 - letters / F.nullif(F.col("word_chars"), F.lit(0)),
    )
    # as generated columns the measures stay where they are: a later filter on them
    # would otherwise be moved below and evaluate them again, piece by piece
    own = [c for c in docs.columns if c not in MEASURES]
    return df.select(*own, F.inline(F.array(F.struct(*MEASURES))))


def _repeat_words(windows: Column) -> Column:
    """Words inside windows whose hash occurs twice or more in the array."""
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        same = lambda j, k: F.get(s, j)["h"] == F.get(s, k)["h"]
        hit = F.transform(s, lambda x, j: F.when(F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)), x["i"]))
        return F.array_sort(F.array_compact(hit))

    start = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
    covered = lambda p: F.aggregate(
        p,
        start,
        lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")),
        lambda a: a["n"],
    )
    # one sort per array: a one-element transform binds it to a name
    heavy = F.get(F.transform(F.array(pairs), lambda s: covered(positions(s))), F.lit(0))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(heavy).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def failed(rules: Sequence[Rule] = RULES) -> Column:
    """Names of the failed rules, in the order of the table."""
    checks = []
    for measure, sign, bound, words in rules:
        m = F.col(measure)
        wrong = m < bound if sign == "<" else m > bound
        checks.append(F.when(wrong & (F.col("n_words") >= words), F.lit(f"{measure} {sign} {bound:g}")))
    return F.array_compact(F.array(*checks))


def judge(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add the measures, base_failed, failed_rules and kept."""
    df = measures(docs, text)
    df = df.withColumns({"base_failed": base_failed(), "failed_rules": failed(rules)})
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
