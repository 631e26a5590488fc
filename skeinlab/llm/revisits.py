"""WARC: not-modified revisits resolved against the latest earlier full response of their canonical URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from skeinlab.llm import common

SPAN = 1 << 16  # time units of a slice; a canonical URL's records are carried from slice to slice

# Header fields that a 304 response may update, and query parameters that do not name a page.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
TRACKING = r"(^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&#]*"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., path without its last slash, query without tracking parameters, no
    scheme, default port or fragment. Null stays null; what is no http URL is kept as it is, trimmed."""
    u = F.trim(url)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, r"^(?i:https?)://([^/?#]*)", 1)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^(?i:https?)://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.regexp_replace(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), TRACKING, "")
    query = F.regexp_replace(F.regexp_replace(query, "&{2,}", "&"), "^&|&$", "")
    whole = F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(host != "", whole).otherwise(u)


def weak(tag: Column) -> Column:
    """An entity tag without its weakness mark."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """records (record_id bigint, url string, warc_time bigint, is_revisit boolean, headers map, digest string,
    length bigint) with url_key, status, source_id, source_digest, source_length and merged headers.

    status: full (a response), resolved, mismatch (the latest earlier response has another entity tag or,
    where either lacks one, another last-modified; neither in common is a mismatch too), orphan (no earlier
    response, or no URL or time). Earlier is by (time, id); a revisit at the response's time and of a higher
    id follows it. Merged headers of a resolved revisit are the response's, with the permitted fields of the
    revisit over them; the others keep their own. Null maps are empty; header names are in lower case.
    Repeated rows repeat. Other columns are not read.

    The as-of join runs in two levels, so that no task holds a URL's whole history: the last response of each
    (URL, slice of time) is an aggregate, a window over the slices carries it on, and a window inside a slice
    does the rest. Payloads are not moved: source_id leads to them."""
    names = ["record_id", "url", "warc_time", "is_revisit", "headers", "digest", "length"]
    base = records.select(*names).withColumn("url_key", canonical_url(F.col("url"))).withColumn("is_revisit", F.coalesce("is_revisit", F.lit(False)))
    base = base.withColumn("headers", F.coalesce("headers", F.create_map().cast("map<string,string>")))
    usable = F.col("url_key").isNotNull() & F.col("warc_time").isNotNull()
    full = F.when(
        ~F.col("is_revisit") & usable,
        F.struct("warc_time", "record_id", "digest", "length", F.col("headers")["etag"].alias("etag"), F.col("headers")["last-modified"].alias("modified"), F.to_json("headers").alias("text")),
    )
    base = base.withColumn("full", full).withColumn("slice", F.floor(F.col("warc_time") / span))
    # max of a struct that starts with (time, id) is the latest response
    slices = base.filter(usable).groupBy("url_key", "slice").agg(F.max("full").alias("latest"))
    carried = slices.select("url_key", "slice", F.last("latest", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    carried = carried.select(F.col("url_key").alias("k"), F.col("slice").alias("s"), "carried")
    inside = Window.partitionBy("url_key", "slice").orderBy("warc_time", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    joined = base.filter(usable).join(carried, (F.col("url_key") == F.col("k")) & (F.col("slice") == F.col("s")), "left")
    before = F.coalesce(F.last("full", ignorenulls=True).over(inside), "carried")
    joined = joined.withColumn("before", F.when(F.col("is_revisit"), before)).drop("k", "s", "carried")
    # rows without URL or time have nothing before them and stay out of the join and the window
    none = F.lit(None).cast(joined.schema["before"].dataType)
    joined = joined.unionByName(base.filter(~usable).withColumn("before", none))
    tags = F.col("before.etag").isNotNull() & F.col("headers")["etag"].isNotNull()
    same = F.when(tags, weak(F.col("before.etag")) == weak(F.col("headers")["etag"])).otherwise(
        F.coalesce(F.col("before.modified") == F.col("headers")["last-modified"], F.lit(False))
    )
    status = F.when(~F.col("is_revisit"), "full").when(F.col("before").isNull(), "orphan").when(same, "resolved").otherwise("mismatch")
    joined = joined.withColumn("status", status)
    ok = F.col("status") == "resolved"
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED))
    older = F.from_json("before.text", "map<string,string>")
    merged = F.map_concat(F.map_filter(older, lambda k, v: ~F.array_contains(F.map_keys(update), k)), update)
    return joined.select(
        *names,
        "url_key",
        "status",
        F.when(ok, F.col("before.record_id")).when(~F.col("is_revisit"), F.col("record_id")).alias("source_id"),
        F.when(ok, F.col("before.digest")).when(~F.col("is_revisit"), F.col("digest")).alias("source_digest"),
        F.when(ok, F.col("before.length")).when(~F.col("is_revisit"), F.col("length")).alias("source_length"),
        F.when(ok, merged).otherwise(F.col("headers")).alias("merged"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """Crawl records of the pages table: each page is a full response (record 2 * page_id) and is asked for
    again by a conditional request (record 2 * page_id + 1): mostly later and answered with the same entity
    tag, weak for some, without tag but with last-modified for others; some tags changed meanwhile, and some
    requests came before the page's own response."""
    p = F.col("page_id")
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.coalesce("html", F.lit(""))), 1, 12), F.lit('"'))
    modified = F.concat(F.lit("day "), (p % 97).cast("string"))
    entry = lambda **kv: F.map_from_arrays(F.array(*[F.lit(k.replace("_", "-")) for k in kv]), F.array(*kv.values()))
    response = F.struct(
        (2 * p).alias("record_id"), "url", (10 * p).alias("warc_time"), F.lit(False).alias("is_revisit"),
        entry(content_type=F.lit("text/html"), content_length=F.octet_length(F.coalesce("html", F.lit(""))).cast("string"), etag=tag, last_modified=modified, date=(10 * p).cast("string"), cache_control=F.lit("max-age=60")).alias("headers"),
        F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("bigint").alias("length"),
    )
    at = F.when(p % 11 == 0, 10 * p - 5).otherwise(10 * p + 7 + (p % 5) * 40_000)
    asked = F.when(p % 7 == 0, F.lit('"changed"')).when(p % 5 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    common_part = dict(last_modified=modified, date=at.cast("string"), expires=(at + 60).cast("string"), content_length=F.lit("0"))
    revisit = F.struct(
        (2 * p + 1).alias("record_id"), "url", at.alias("warc_time"), F.lit(True).alias("is_revisit"),
        F.when(p % 3 == 0, entry(**common_part)).otherwise(entry(etag=asked, **common_part)).alias("headers"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("bigint").alias("length"),
    )
    return pages.select(F.explode(F.array(response, revisit)).alias("r")).select("r.*")


def op3_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crawl records made of pages (see captures), resolved; headers as text. Nulls, ties and repeated rows as in
    resolve; an empty table gives no rows."""
    found = resolve(captures(common.table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("merged")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.select("record_id", F.floor(F.col("record_id") / 2).alias("page_id"), "url_key", "status", "source_id", "source_digest", "source_length", shown.alias("headers"))


ORACLE = r"""
WITH p AS (
  SELECT page_id AS p, coalesce(html, '') AS html, trim(url) AS u,
         regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^(?i:https?)://([^/?#]*)', 1)), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(trim(url), '^(?i:https?)://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
         regexp_replace(regexp_replace(regexp_replace(regexp_extract(trim(url), '^[^?#]*\?([^#]*)', 1),
           '(^|&)(?:utm_[a-z]+|ref|fbclid|gclid)=[^&#]*', '', 'g'), '&{2,}', '&', 'g'), '^&|&$', '', 'g') AS query
  FROM pages),
k AS (
  SELECT *, CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END ELSE u END AS url_key,
         '"' || substring(md5(html), 1, 12) || '"' AS tag, 'day ' || (p % 97) AS modified, sha256(html) AS digest, strlen(html) AS len,
         CASE WHEN p % 11 = 0 THEN 10 * p - 5 ELSE 10 * p + 7 + (p % 5) * 40000 END AS seen_at
  FROM p),
r AS (
  SELECT 2 * p AS record_id, p AS page_id, url_key, 10 * p AS t, tag, modified, digest, len FROM k),
v AS (
  SELECT 2 * p + 1 AS record_id, p AS page_id, url_key, seen_at AS t, modified, seen_at,
         CASE WHEN p % 3 = 0 THEN NULL WHEN p % 7 = 0 THEN '"changed"' WHEN p % 5 = 0 THEN 'W/' || tag ELSE tag END AS tag
  FROM k),
j AS (
  SELECT v.record_id, v.page_id, v.url_key, v.tag AS vtag, v.modified AS vmod, v.seen_at,
         max(struct_pack(t := r.t, id := r.record_id, digest := r.digest, len := r.len, tag := r.tag, modified := r.modified)) AS b
  FROM v LEFT JOIN r ON v.url_key = r.url_key AND (r.t < v.t OR (r.t = v.t AND r.record_id < v.record_id))
  GROUP BY ALL),
s AS (
  SELECT *, CASE WHEN b.id IS NULL THEN 'orphan'
                 WHEN CASE WHEN vtag IS NOT NULL THEN b.tag = regexp_replace(vtag, '^W/', '') ELSE b.modified = vmod END THEN 'resolved'
                 ELSE 'mismatch' END AS status FROM j)
SELECT record_id, page_id, url_key, 'full' AS status, record_id AS source_id, digest AS source_digest, CAST(len AS BIGINT) AS source_length,
       'cache-control=max-age=60;content-length=' || len || ';content-type=text/html;date=' || t || ';etag=' || tag || ';last-modified=' || modified AS headers
FROM r
UNION ALL
SELECT record_id, page_id, url_key, status, CASE WHEN status = 'resolved' THEN b.id END, CASE WHEN status = 'resolved' THEN b.digest END,
       CASE WHEN status = 'resolved' THEN CAST(b.len AS BIGINT) END,
       CASE WHEN status = 'resolved'
            THEN 'cache-control=max-age=60;content-length=' || b.len || ';content-type=text/html;date=' || seen_at || ';etag=' || coalesce(vtag, b.tag)
                 || ';expires=' || (seen_at + 60) || ';last-modified=' || b.modified
            ELSE 'content-length=0;date=' || seen_at || coalesce(';etag=' || vtag, '') || ';expires=' || (seen_at + 60) || ';last-modified=' || vmod END
FROM s
"""
