"""Resolution of not-modified revisit records by an as-of join on the canonical URL.

A 304 revisit holds no page: it points at the latest earlier full response of its URL. Records are
dealt to ranges ordered by URL, time and record, so a URL with any number of captures is spread over as many ranges
as it needs; inside a range a running window finds the last response, and the last response of the
ranges before is carried in for the few URLs that a boundary cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import held

#: Header fields that a 304 response may update (fixed by the HTTP standard).
PERMITTED = ["cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Query parameters that do not name another page.
TRACKING = r"^(utm_[a-z]*|ref|fbclid|gclid|sessionid|phpsessid|jsessionid)(=.*)?$"


def canonical_url(url: Column) -> Column:
    """Host without user, ``www.`` and default port in lower case, path without last slash, sorted query without
    tracking parameters; scheme and fragment are dropped."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^[^@]*@", ""))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www[0-9]*\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.filter(F.split(F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1), "&"),
                     lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))
    query = F.array_join(F.array_sort(query), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _lower_names(headers: Column) -> Column:
    """Header map with lower-case names; of names that differ in case only the least stays. Null is empty."""
    entries = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    names = F.transform(entries, lambda e: e["key"])
    first = F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1)
    return F.coalesce(F.map_from_entries(first), F.create_map().cast("map<string,string>"))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), r"^[Ww]/", "")


def resolve_revisits(records: DataFrame) -> DataFrame:
    """One row per not-modified revisit: record_id, canonical_url, response_id, verdict, headers, payload_digest.

    ``records``: record_id long, url string, ts timestamp, type (``response`` or ``revisit``), status int, headers
    map<string,string>, payload_digest string; other columns are not read. Full responses are those of status 200,
    not-modified revisits those of status 304. Earlier means a smaller (ts, record_id).

    verdict: ``resolved`` (entity tags equal under weak comparison, or, unless both have one, equal
    last-modified fields), ``mismatch`` (the compared validators differ), ``no-validator`` (nothing to compare) or ``no-response`` (no
    earlier response; null URL or time). Resolved rows have the response's headers, updated by the PERMITTED ones of the
    revisit, and its digest; mismatch and no-validator rows name the response only; else these are null. Missing headers count as
    none. Repeated records are each answered; an empty table gives an empty result.
    """
    r = records.select("record_id", canonical_url(F.col("url")).alias("u"), "ts", F.col("type") == "response", "status",
                       _lower_names(F.col("headers")).alias("headers"), "payload_digest") \
        .toDF("record_id", "u", "ts", "full", "status", "headers", "payload_digest")
    is_revisit = (F.col("status") == 304) & ~F.col("full")
    r = r.filter(((F.col("status") == 200) & F.col("full")) | is_revisit)
    placed = r.filter("u is not null and ts is not null")
    lost = r.filter("(u is null or ts is null) and not full")
    dealt = held(placed.repartitionByRange("u", "ts", "record_id").withColumn("part", F.spark_partition_id()))
    response = F.struct(F.col("record_id").alias("id"), F.col("headers").alias("headers"), F.col("payload_digest").alias("digest"))
    run = W.partitionBy("part", "u").orderBy("ts", "record_id").rowsBetween(W.unboundedPreceding, -1)
    own = dealt.withColumn("own", F.last(F.when(F.col("full"), response), ignorenulls=True).over(run)).filter("not full")
    # URLs that lie in several ranges: fewer than there are ranges
    cut = dealt.groupBy("u").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo < hi")
    tails = dealt.join(F.broadcast(cut.select("u")), "u").groupBy("u", "part").agg(
        F.max_by(F.when(F.col("full"), response), F.when(F.col("full"), F.struct("ts", "record_id"))).alias("tail"))
    before = W.partitionBy("u").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carry = tails.select("u", "part", F.last("tail", ignorenulls=True).over(before).alias("carry"))
    found = own.join(F.broadcast(carry), ["u", "part"], "left").select(
        "record_id", "u", "headers", F.coalesce("own", "carry").alias("resp"))
    found = found.unionByName(lost.select("record_id", "u", "headers"), allowMissingColumns=True)

    new, old = F.col("headers"), F.col("resp.headers")
    both = lambda name: new[name].isNotNull() & old[name].isNotNull()
    verdict = F.when(F.col("resp").isNull(), "no-response") \
        .when(both("etag"), F.when(_strong(new["etag"]) == _strong(old["etag"]), "resolved").otherwise("mismatch")) \
        .when(both("last-modified"), F.when(F.trim(new["last-modified"]) == F.trim(old["last-modified"]), "resolved").otherwise("mismatch")) \
        .otherwise("no-validator")
    allowed = F.array(*(F.lit(h) for h in PERMITTED))
    merged = F.map_concat(
        F.map_filter(old, lambda k, v: ~(F.array_contains(allowed, k) & F.map_contains_key(new, k))),
        F.map_filter(new, lambda k, v: F.array_contains(allowed, k)))
    ok = F.col("verdict") == "resolved"
    return found.withColumn("verdict", verdict).select(
        "record_id", F.col("u").alias("canonical_url"), F.col("resp.id").alias("response_id"), "verdict",
        F.when(ok, merged).alias("headers"), F.when(ok, F.col("resp.digest")).alias("payload_digest"))


def captures_of(pages: DataFrame) -> DataFrame:
    """The given pages as capture records: each page once in full, with three later or earlier not-modified visits.

    Only gives rows in the schema of ``resolve_revisits``: the visits differ in address form, time and validators.
    """
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60)
    tag = F.concat(F.lit('"'), F.md5("html"), F.lit('"'))
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd HH:mm:ss")
    hour = lambda n: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60 + 3600 * n)

    def record(n, url, ts, kind, status, headers):
        return F.struct((F.col("page_id") * 4 + n).alias("record_id"), url.alias("url"), ts.alias("ts"), F.lit(kind).alias("type"),
                        F.lit(status).alias("status"), F.create_map(*(x for k, v in headers.items() for x in (F.lit(k), v))).alias("headers"),
                        (F.sha1("html") if n == 0 else F.lit(None).cast("string")).alias("payload_digest"))
    url = F.col("url")
    visits = F.array(
        record(0, url, at, "response", 200, {"Content-Type": F.lit("text/html"), "ETag": tag, "Last-Modified": stamp(at), "Date": stamp(at),
                                             "Cache-Control": F.lit("max-age=60"), "Server": F.lit("origin")}),
        record(1, F.concat(url, F.lit("#again")), hour(1), "revisit", 304,
               {"ETag": F.concat(F.lit("W/"), tag), "Date": stamp(hour(1)), "Cache-Control": F.lit("max-age=120"), "Server": F.lit("cache")}),
        record(2, F.concat(F.lit("HTTPS://WWW."), F.regexp_replace(url, r"^[a-z]+://(www\.)?", "")), hour(30), "revisit", 304,
               {"Last-Modified": stamp(at), "Date": stamp(hour(30)), "X-Other": F.lit("1")}),
        record(3, url, hour(-1), "revisit", 304, {"Date": stamp(hour(-1))}))
    return pages.select(F.explode(visits).alias("r")).select("r.*")
