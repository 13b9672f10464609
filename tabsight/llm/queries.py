"""Registered queries of the operators of this package, one per operator, over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, imatch, linededup, maintext, nearpath, negatives, packing, periods, quality, revisit, secrets, shards, suffixtree
from .common import shared_folder, stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@query("op1_best_fit_packing")
def _(spark, sf):
    pieces = packing.token_pieces(table(spark, sf, "documents"), WORD_TOKENIZER)
    return packing.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


@query("op2_byte_bpe")
def _(spark, sf):
    coded = bpe.encode(table(spark, sf, "documents"), BYTE_RANKS, decoded=True)
    return coded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op3_line_dedup")
def _(spark, sf):
    d = linededup.deduplicate(table(spark, sf, "documents"), run_words=linededup.RUN_WORDS)
    return d.select("doc_id", "removed_lines", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@query("op4_suffix_tree_scores")
def _(spark, sf):
    scores, tree = suffixtree.score_documents(table(spark, sf, "documents"))
    names = ("n_tokens", "n_known", F.lit(tree.total).cast("long").alias("train_tokens"), "base_score", "score")
    return scores.select("doc_id", "held_out", *names)


def captures(pages: DataFrame) -> DataFrame:
    """Two captures of every page: a full response, and later a not-modified answer under another spelling of its URL.

    Every seventh answer has the tag of another version, every eleventh page was
    never fetched whole, every fifth answer has a date but no tag. Every third page
    was fetched again, changed, after the answer.
    """
    i, url = F.col("page_id"), F.col("url")
    seen = i % 4096 + 1 + i * 7919 % 5000
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    date = F.concat(F.lit("day "), (i % 1000).cast("string"))
    pair = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    full = F.struct(
        (i * 2).alias("record_id"), url.alias("url"), (i % 4096).alias("captured_at"), F.lit("response").alias("kind"), tag.alias("etag"), date.alias("last_modified"),
        pair("Content-Type", "text/html", "Content-Length", F.octet_length("html").cast("string"), "ETag", tag, "Cache-Control", "max-age=60").alias("headers"),
        F.col("html").alias("payload"),
    )
    spelled = F.concat(F.lit("HTTPS://www."), F.regexp_replace(url, r"^[a-z]+://(?:www\.|m\.)?", ""), F.lit("#again"))
    answer_tag = F.when(i % 7 == 0, F.lit('"other"')).when(i % 5 != 0, F.concat(F.lit("W/"), tag))
    again = F.struct(
        (i * 2 + 1).alias("record_id"), spelled.alias("url"), seen.alias("captured_at"), F.lit("revisit").alias("kind"), answer_tag.alias("etag"), date.alias("last_modified"),
        pair("content-length", "0", "cache-control", "max-age=3600", "X-Seen", i.cast("string")).alias("headers"),
        F.lit(None).cast("string").alias("payload"),
    )
    text, new = F.concat(F.lit("later "), i.cast("string")), F.lit('"later"')
    later = F.struct(
        (-i - 1).alias("record_id"), url.alias("url"), (seen + 1 + i % 100).alias("captured_at"), F.lit("response").alias("kind"), new.alias("etag"), date.alias("last_modified"),
        pair("Content-Type", "text/html", "Content-Length", F.octet_length(text).cast("string"), "ETag", new, "Cache-Control", "max-age=60").alias("headers"),
        text.alias("payload"),
    )
    all_of = [F.when(i % 11 != 0, full), again, F.when(i % 3 == 0, later)]
    return pages.select(F.inline(F.array_compact(F.array(*all_of))))


_REVISIT_SQL = r"""WITH p AS (SELECT page_id AS i, url, html, '"' || md5(coalesce(html, '')) || '"' AS tag, 'day ' || (page_id % 1000) AS day FROM pages),
    r AS (SELECT i * 2 AS record_id, url, i % 4096 AS tm, 'response' AS kind, tag AS etag, day, CAST(strlen(html) AS VARCHAR) AS size, html, i, tag FROM p WHERE i % 11 <> 0
      UNION ALL SELECT i * 2 + 1, 'HTTPS://www.' || regexp_replace(url, '^[a-z]+://(?:www\.|m\.)?', '') || '#again', i % 4096 + 1 + i * 7919 % 5000, 'revisit',
        CASE WHEN i % 7 = 0 THEN '"other"' WHEN i % 5 <> 0 THEN 'W/' || tag END, day, NULL, NULL, i, tag FROM p
      UNION ALL SELECT -i - 1, url, i % 4096 + 2 + i * 7919 % 5000 + i % 100, 'response', '"later"', day, CAST(strlen('later ' || i) AS VARCHAR), 'later ' || i, i, tag FROM p WHERE i % 3 = 0),
    b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare FROM r),
    c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^.*@', ''), ':(?:80|443)$', ''), '^(?:www|m)\.', '')
        || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS stem,
        list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)(=|$)'))) AS q FROM b),
    u AS (SELECT *, stem || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS page FROM c),
    w AS (SELECT *, last_value(CASE WHEN kind = 'response' THEN {'id': record_id, 'tag': etag, 'day': day, 'size': size, 'html': html} END IGNORE NULLS)
        OVER (PARTITION BY page ORDER BY tm, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM u),
    s AS (SELECT *, CASE WHEN kind = 'response' THEN 'full' WHEN e IS NULL THEN 'no_earlier_response'
        WHEN CASE WHEN etag IS NOT NULL THEN regexp_replace(etag, '^W/', '') = e.tag ELSE day = e.day END THEN 'resolved' ELSE 'validator_mismatch' END AS status FROM w)
    SELECT record_id, page, tm AS captured_at, status, CASE WHEN status = 'resolved' THEN e.id END AS refers_to,
      CASE status WHEN 'full' THEN 'cache-control=max-age=60;content-length=' || size || ';content-type=text/html;etag=' || etag
        WHEN 'resolved' THEN 'cache-control=max-age=3600;content-length=' || e.size || ';content-type=text/html;etag=' || e.tag || ';x-seen=' || i
        ELSE 'cache-control=max-age=3600;content-length=0;x-seen=' || i END AS headers,
      sha256(CASE status WHEN 'full' THEN html WHEN 'resolved' THEN e.html END) AS payload_sha256 FROM s"""


@query("op5_revisit_resolution", _REVISIT_SQL)
def _(spark, sf):
    found = revisit.resolve(captures(table(spark, sf, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    names = ("record_id", "page", "captured_at", "status", "refers_to")
    return found.select(*names, F.array_join(lines, ";").alias("headers"), F.sha2("payload", 256).alias("payload_sha256"))


@query("op6_minhash_near_dedup")
def _(spark, sf):
    found = nearpath.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


_BASE_KINDS = [r.kind for r in secrets.BASE]


def _scan_sql() -> str:
    """Positions from the lengths of matches and of what lies between them, as DuckDB SQL."""
    patterns = {
        "assign": (r"""(?i:(?:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+""", r"""^[A-Za-z_]+["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$""", 6),
        "access": ("AKIA[A-Z0-9]+", "(.*)", 20),
        "hex": ("[0-9a-f]{24,}", "(.*)", 24),
        "pem": ("-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "(.*)", 1),
        "jwt": (r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", "(.*)", 1),
        "hosted": ("gh[pousr]_[A-Za-z0-9]{36,}", "(.*)", 1),
    }
    each = " UNION ALL ".join(
        f"""SELECT id, {rank} AS rank, '{kind}' AS kind, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1),
            lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))) AS s, '{part}' AS part, {least} AS least
            FROM (SELECT id, regexp_extract_all(t, '{pattern}') AS ms, regexp_split_to_array(t, '{pattern}') AS gaps FROM d WHERE regexp_matches(t, '{pattern}'))"""
        for rank, (kind, (pattern, part, least)) in enumerate(patterns.items())
    )
    joined = lambda cond: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (WHERE {cond}), '')"
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in _BASE_KINDS)
    return f"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
        h AS (SELECT id, rank, kind, CAST(s AS BIGINT) AS s, CAST(s + length(m) AS BIGINT) AS e FROM ({each}) WHERE length(regexp_extract(m, part, 1)) >= least)
        SELECT doc_id, {counts}, sha256({joined("rank < 3")}) AS base_sha256, {joined("true")} AS spans
        FROM d LEFT JOIN h USING (id) GROUP BY id, doc_id"""


@query("op7_secret_ledger", _scan_sql())
def _(spark, sf):
    docs = table(spark, sf, "documents")
    # two rounds over one ledger: the base rules on half of the blobs, then all rules on all, of which only unseen pairs are scanned
    place = shared_folder(spark, "ledger")
    half = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    secrets.append(docs.where(half), place, secrets.BASE)
    ledger = secrets.append(docs, place)
    found = secrets.findings(docs, ledger)
    count = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *[count(k) for k in _BASE_KINDS],
        F.sha2(secrets.joined_spans(F.col("found"), _BASE_KINDS), 256).alias("base_sha256"),
        secrets.joined_spans(F.col("found")).alias("spans"),
    )


@query("op8_minimax_shards")
def _(spark, sf):
    placed = shards.shard(table(spark, sf, "documents"))
    law = (F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    return placed.select("doc_id", "size", "text_crc32", *law)


@query("op9_imatch_fingerprints")
def _(spark, sf):
    return imatch.compare(table(spark, sf, "documents"))


_WORD = r"[^\x20\x09-\x0D]"


def _quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    wrong = " OR ".join(f"(coalesce({m} {s} {b}, false) AND n_words >= {n})" for m, s, b, n in quality.RULES)
    return rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT *, regexp_extract_all(t, '{_WORD}+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS ls FROM d),
        g AS (SELECT id, i, ws[i:i + 4] AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
        r AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS n FROM g) WHERE n > 1),
        p AS (SELECT id, count(DISTINCT i + k) AS n FROM r, range(0, 5) AS o(k) GROUP BY 1),
        m AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
          len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(ls) AS n_lines,
          len(list_intersect(list_transform(list_distinct(ws), lambda x: lower(x)), [{stop}])) AS stop_words, length(regexp_replace(t, '[\s\x0B\p{{L}}]', '', 'g')) AS others
          FROM w LEFT JOIN p USING (id)),
        x AS (SELECT *, word_chars / nullif(n_words, 0) AS mean_word_length, n_symbols / nullif(n_words, 0) AS symbol_ratio, n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio,
          1 - others / nullif(word_chars, 0) AS alpha_ratio, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR {wrong}) AS kept FROM x"""


@query("op10_quality_rules", _quality_sql())
def _(spark, sf):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality.judge(table(spark, sf, "documents")).select(*names)


@query("op11_host_suffix_extraction")
def _(spark, sf):
    found = maintext.extract(table(spark, sf, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op12_block_convolution_runs")
def _(spark, sf):
    docs = periods.with_planted_period(table(spark, sf, "documents").select("doc_id", "text"))
    found = periods.collapse(docs)
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("length"), r["start"].alias("start"), r["period"].alias("period"))))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    length = -F.col("longest.length")
    return found.withColumn("longest", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("longest.start").alias("start"),
        length.alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("(-1000 * longest.length) div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_NEGATIVES_SQL = """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS o, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score, a.label = b.label AS same FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, o) AS rk FROM s WHERE same),
    n AS (SELECT p.anchor_id, p.o AS positive_id, p.score AS positive_score, s.o AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.o ORDER BY s.score DESC, s.o) AS rk
      FROM p JOIN s USING (anchor_id) WHERE p.rk <= 5 AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
    SELECT anchor_id, positive_id, CAST(rk AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rk <= 5"""


@query("op13_threshold_negatives", _NEGATIVES_SQL)
def _(spark, sf):
    e, i = table(spark, sf, "embeddings"), F.col("vec_id")
    label = F.when(i % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    return negatives.mine(e.select(i.alias("id"), label, (i % 100 == 0).alias("anchor"), negatives.whole_components(F.col("embedding")).alias("q")))
