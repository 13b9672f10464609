"""Secret scans over an incremental ledger of text blobs.

Every version of every text is addressed by its SHA-256. The ledger holds, for
each blob and rule version already scanned, the spans found (none is a row
too); a scan covers only the blob and rule-version pairs that the ledger lacks,
and the findings are joined back to all paths that hold the blob. DataFrame
functions only.

Spans are code points, end exclusive. Matches are leftmost and do not overlap
within a rule; a rule may ask for a least length of the match or of its last
group, and shorter matches are dropped after matching.

Defined cases: a null text is the empty text and has no findings; repeated
rows and copies share one blob; other columns pass through `redact` and are
ignored elsewhere; an empty table gives an empty ledger and no findings.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import beside_content, stored, text_of, unpacked, whole_rows


@dataclass(frozen=True)
class Rule:
    """`least` counts characters of `group`."""

    kind: str
    version: int
    pattern: str
    least: int = 1
    group: int = 0


# The three base rules, in order.
BASE = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, 0),
    # a maximal run of 24 or more is what the plain run yields after dropping short ones
    Rule("hex", 1, r"[0-9a-f]{24,}", 24, 0),
)
# Further public key formats.
MORE = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("hosted", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + MORE

LEDGER = "blob binary, kind string, version int, spans array<struct<start:int,end:int>>"


def blob_of(text: str = "text") -> Column:
    return F.unhex(F.sha2(text_of(text), 256))


def spans_of(text: Column, rule: Rule) -> Column:
    """Array of (start, end) of the rule's matches, from the lengths of matches and of what lies between."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    between = F.split(text, rule.pattern, -1)
    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + F.length(x["m"])
        part = F.regexp_extract(x["m"], rule.pattern, rule.group) if rule.group else x["m"]
        one = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(part) >= rule.least, F.concat(a["out"], one)).otherwise(a["out"]).alias("out"))

    listed = F.aggregate(steps, begin, step, lambda a: a["out"])
    return F.when(text.rlike(rule.pattern), listed).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Ledger rows of the unseen (blob, rule version) pairs of `docs`."""
    blobs = docs.select(blob_of(text).alias("blob"), text_of(text).alias("t")).dropDuplicates(["blob"])
    kinds = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is not None:
        have = ledger.groupBy("blob").agg(F.collect_set(F.struct("kind", "version")).alias("have"))  # one entry per rule version
        blobs = blobs.join(have, "blob", "left")
        todo = F.array_except(kinds, F.coalesce("have", F.array().cast("array<struct<kind:string,version:int>>")))
    else:
        todo = kinds
    unseen = blobs.withColumn("todo", todo).where(F.size("todo") > 0)
    found = [
        F.when(
            F.array_contains("todo", F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"))),
            F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("t"), r).alias("spans")),
        )
        for r in rules
    ]
    return unseen.select("blob", F.inline(F.array_compact(F.array(*found))))


def append(docs: DataFrame, path: str, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """Scan what the ledger stored at `path` (a folder, made if missing) has not seen, add it there, and return the whole ledger.

    New rows are written before the ledger is touched, so a failed run leaves it
    as it was, and the next one scans the same pairs.
    """
    spark = docs.sparkSession
    try:
        known = spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    stored(scan(docs, known, rules, text)).write.mode("append").parquet(path)
    return spark.read.schema(LEDGER).parquet(path)


def findings(docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """(doc_id, blob, found): every path with the spans of its blob by start, then by the order of the rules."""
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.kind, i)])
    current = " or ".join(f"(kind = '{r.kind}' and version = {r.version})" for r in rules)
    hits = ledger.where(current).where(F.size("spans") > 0).dropDuplicates(["blob", "kind", "version"])
    entry = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), order[F.col("kind")].alias("rank"), F.col("kind").alias("kind"), s["end"].alias("end")))
    lists = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(entry))).alias("found"))
    paths = docs.select("doc_id", blob_of(text).alias("blob"))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return paths.join(lists, "blob", "left").select("doc_id", "blob", F.coalesce("found", none).alias("found"))


def joined_spans(found: Column, kinds: Sequence[str] | None = None) -> Column:
    """kind:start:end by start, then kind, comma-joined."""
    if kinds is not None:
        found = F.filter(found, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The documents with every found span replaced by `mark`; overlapping spans become one."""
    hits = findings(docs.select("doc_id", text), ledger, rules, text).where(F.size("found") > 0)
    spans = hits.groupBy("blob").agg(F.any_value("found").alias("found"))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    t = F.col("row").getField(text)

    def step(a: Column, x: Column) -> Column:
        new = x["start"] >= a["at"]
        gap = F.substring(t, a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
        return F.struct(F.when(new, F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"]).alias("out"), F.greatest(a["at"], x["end"]).alias("at"))

    clean = F.aggregate("found", begin, step, lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    rows = whole_rows(docs, id=F.col("doc_id"), content=blob_of(text))
    return unpacked(beside_content(rows, spans.withColumnRenamed("blob", "content")), docs.columns, {text: F.when(F.col("found").isNull(), t).otherwise(clean)})
