"""Not-modified revisits of web archives, resolved to the response they refer to.

A revisit record says that a page had not changed. It is joined, by canonical
URL and time, to the latest earlier full response; the validators of both must
agree; then the response's payload stands for it, and its stored headers are
updated by those that a not-modified answer may carry.

Records are ordered by (URL, time, record) in slices, so a URL with a third of
all captures spreads over many tasks; the last full response of a slice is
handed on to the slices after it.

Records have record_id, url, captured_at, kind ('response' or 'revisit'), etag,
last_modified, headers (a map, names in any case) and payload. Defined cases: a
record without url stands alone, one without captured_at comes first; equal
times are ordered by record_id, and a response serves only revisits after it; a
response without record_id serves none; every full record keeps the payload of
its own row, also without a record_id or with one that other rows have; of repeated rows each is resolved; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import slices, stored

# Fields that describe the stored payload and that a not-modified answer doesn't replace.
KEPT_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "content-md5", "digest", "trailer", "transfer-encoding", "connection", "keep-alive", "upgrade", "te", "proxy-authenticate")
REFERENCE = "struct<record_id:bigint,etag:string,last_modified:string,captured_at:bigint,tie:bigint>"
# Query parameters that name a visit, not a page.
TRACKING = r"(?:utm_[a-z]+|ref|fbclid|gclid|sessionid)"


def canonical_url(url: Column) -> Column:
    """Without scheme, user, leading www. or m., default port, fragment, tracking parameters and closing slash; host in lower case, parameters sorted."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":(?:80|443)$", ""), r"^(?:www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    query = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(=|$)")))
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(""))


def lower_names(headers: Column) -> Column:
    """The map with lower-case names; of names that become equal the last in order stays."""
    entries = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("k"), e["key"].alias("name"), e["value"].alias("v")))

    def last_of_each(e: Column) -> Column:
        marked = F.transform(e, lambda p, i: F.struct(p["k"].alias("k"), p["v"].alias("v"), F.coalesce(F.get(e, i + 1)["k"] != p["k"], F.lit(True)).alias("last")))
        return F.transform(F.filter(marked, lambda p: p["last"]), lambda p: F.struct(p["k"], p["v"]))

    pairs = F.get(F.transform(F.array(F.array_sort(entries)), last_of_each), F.lit(0))
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>"))


def merged_headers(stored: Column, fresh: Column) -> Column:
    """The stored headers, with those of the not-modified answer that may replace them."""
    permitted = F.map_filter(fresh, lambda k, v: ~k.isin(*KEPT_HEADERS))
    return F.map_concat(F.map_filter(stored, lambda k, v: ~F.map_contains_key(permitted, k)), permitted)


def agreeing(etag: Column, modified: Column, stored_etag: Column, stored_modified: Column) -> Column:
    """Weak comparison of entity tags where both have one, else equal dates, else unconfirmed."""
    weak = lambda e: F.regexp_replace(e, "^W/", "")
    by_tag = etag.isNotNull() & stored_etag.isNotNull()
    return F.when(by_tag, weak(etag) == weak(stored_etag)).otherwise(F.coalesce(modified == stored_modified, F.lit(False)))


def tie_of() -> Column:
    """A hash over what else tells records apart, so that the order of records is one and the same everywhere."""
    return F.xxhash64("url", "etag", "last_modified", F.array_sort(F.map_entries("headers")), "payload")


def latest_earlier(records: DataFrame) -> DataFrame:
    """The records (without payload) with `earlier`, the latest full response of the same canonical URL before them."""
    full = (F.col("kind") == "response") & F.col("record_id").isNotNull()
    small = records.select(
        "record_id", "captured_at", "kind", "etag", "last_modified", "headers", canonical_url(F.col("url")).alias("page"), tie_of().alias("tie")
    )
    alone = small.where("page is null").withColumn("earlier", F.lit(None).cast(REFERENCE))
    cut = slices(small.where("page is not null"), "page", "captured_at", "record_id", "tie")
    reference = F.when(full, F.struct("record_id", "etag", "last_modified", "captured_at", "tie"))
    order = ["captured_at", "record_id", "tie"]
    inside = Window.partitionBy("slice", "page").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = cut.withColumn("own", F.last(reference, ignorenulls=True).over(inside))
    # what each slice hands on: one row a slice
    edges = cut.groupBy("slice").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    place = F.struct(F.col("captured_at").isNotNull().alias("k"), "captured_at", F.col("record_id").isNotNull().alias("r"), "record_id", "tie")
    last_full = cut.where(full).join(F.broadcast(edges), "slice").where("page = last_page").groupBy("slice").agg(F.max_by(reference, place).alias("handed"))
    giving = edges.join(last_full, "slice").select(F.col("slice").alias("from_slice"), F.col("last_page").alias("page"), "handed")
    before = (F.col("first_page") == F.col("page")) & (F.col("from_slice") < F.col("slice"))
    taken = edges.join(F.broadcast(giving), before).groupBy("slice", F.col("first_page").alias("page")).agg(F.max_by("handed", "from_slice").alias("handed"))
    joined = seen.join(F.broadcast(taken), ["slice", "page"], "left").withColumn("earlier", F.coalesce("own", "handed"))
    names = [*small.columns, "earlier"]
    return joined.select(*names).union(alone.select(*names))


def _place(page: str, time: str, record: str, tie: str) -> Column:
    """Time, record, tie and page as one key; a null time has a mark of its own."""
    return F.concat_ws("|", F.coalesce(F.col(time).cast("string"), F.lit("-")), F.col(record).cast("string"), F.col(tie).cast("string"), F.col(page))


def resolve(records: DataFrame) -> DataFrame:
    """(record_id, page, captured_at, status, refers_to, headers, payload) of each record.

    status: 'full'; for revisits 'resolved', 'validator_mismatch' or
    'no_earlier_response', the last two with their own headers and no payload.
    """
    revisit = F.coalesce(F.col("kind") == "revisit", F.lit(False))
    own = lower_names(F.col("headers"))
    # full records keep the payload of their row
    none = F.lit(None)
    whole = records.where(~revisit).select(
        "record_id", canonical_url(F.col("url")).alias("page"), "captured_at", F.lit("full").alias("status"), none.cast("bigint").alias("refers_to"), own.alias("headers"), "payload"
    )
    agree = agreeing(F.col("etag"), F.col("last_modified"), F.col("earlier.etag"), F.col("earlier.last_modified"))
    status = F.when(F.col("earlier").isNull(), "no_earlier_response").when(agree, "resolved").otherwise("validator_mismatch")
    judged = stored(latest_earlier(records).where(revisit).select("record_id", "page", "captured_at", status.alias("status"), own.alias("headers"), "earlier"))
    alone = judged.where("status <> 'resolved'").select("record_id", "page", "captured_at", "status", none.cast("bigint").alias("refers_to"), "headers", none.cast("string").alias("payload"))
    # by the place of the row referred to, as a record_id may stand on several; each payload moves once
    asking = judged.where("status = 'resolved'").withColumn("_at", _place("page", "earlier.captured_at", "earlier.record_id", "earlier.tie"))
    bodies = records.where((F.col("kind") == "response") & F.col("record_id").isNotNull()).select(
        canonical_url(F.col("url")).alias("page"), "captured_at", "record_id", tie_of().alias("tie"), own.alias("_stored"), "payload"
    )
    bodies = bodies.where("page IS NOT NULL").groupBy(_place("page", "captured_at", "record_id", "tie").alias("_at")).agg(F.any_value("_stored").alias("_stored"), F.any_value("payload").alias("payload"))
    merged = merged_headers(F.col("_stored"), F.col("headers")).alias("headers")
    found = asking.join(bodies, "_at").select("record_id", "page", "captured_at", "status", F.col("earlier.record_id").alias("refers_to"), merged, "payload")
    return whole.union(alone).union(found)
