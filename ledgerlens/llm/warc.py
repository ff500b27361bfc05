"""Resolution of not-modified revisits in web captures.

A server that answers 304 sends no body: the capture is a *revisit* and stands
for an earlier full response of the same address.  Each revisit is resolved by
an as-of join on the canonical address to the latest earlier full response; the
validators of both are compared, and the headers that a 304 may update are
merged into those of the stored response.

The as-of join goes in two levels, so that an address with a third of all
captures is not one task: inside (address, period) a window carries the latest
response forward; the last response of each period is carried over periods on a
table of one row a period, which a join brings back.  Bodies never move, only
the records' addresses, times, validators and headers.

Defined cases: a revisit without an earlier response is ``unresolved``; equal
times are ordered by record id, a response before a revisit of the same moment;
repeated records are kept as they are; null addresses match nothing and null
times come before all others; a validator missing on either side is not compared
(``unverified`` when none can be); null header maps count as empty; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerlens.llm.common import written

# Headers that describe the stored body, which a 304 must not change (RFC 9111, 3.2),
# and headers of one connection.  Tracking parameters dropped from addresses.
NOT_MERGED = ("content-encoding", "content-length", "content-range", "content-type", "connection", "keep-alive", "proxy-authenticate",
              "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade")
TRACKING = "^(utm_[a-z]+|gclid|fbclid|ref|sessionid|phpsessid|jsessionid)="
FULL, REVISIT = "response", "revisit"


def canonical(url: Column) -> Column:
    """Scheme and host in lower case, no user, default port, fragment or tracking parameters; parameters sorted; no trailing slash."""
    pattern = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?"
    part = lambda i: F.regexp_extract(url, pattern, i)
    scheme = F.lower(part(1))
    host = F.when(scheme == "https", F.regexp_replace(F.lower(part(2)), r"^(.*?)\.?(:443)?$", "$1")).otherwise(F.regexp_replace(F.lower(part(2)), r"^(.*?)\.?(:80)?$", "$1"))
    path = F.regexp_replace(part(3), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(p).rlike(TRACKING))), "&")
    return F.when(url.rlike(pattern), F.concat(F.when(scheme == "https", "http").otherwise(scheme), F.lit("://"), host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def _etag(x: Column) -> Column:
    """Weak comparison: the opaque part of an entity tag."""
    return F.regexp_replace(x, "^W/", "")


def _header(headers: Column, name: str) -> Column:
    return F.element_at(headers, F.lit(name))


def resolve(captures: DataFrame, period_seconds: int = 86_400) -> DataFrame:
    """One row per revisit: (record_id, canonical_url, refers_to, age_seconds, verdict, headers).

    ``captures``: record_id, url, captured (seconds), kind ('response' or
    'revisit'), headers (lower-case names).  ``verdict``: ``confirmed``,
    ``mismatch`` (a validator differs; not merged), ``unverified`` or ``unresolved``.
    """
    full = F.col("kind") == FULL
    headers = F.coalesce(F.col("headers"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    rows = captures.select("record_id", canonical(F.col("url")).alias("address"), F.col("captured").cast("long").alias("at"), "kind", headers.alias("headers"))
    rows = rows.where("address IS NOT NULL OR kind = 'revisit'").withColumn("period", F.floor(F.col("at") / period_seconds))
    rows = written(rows.withColumn("turn", F.when(full, 0).otherwise(1)))  # narrow, and read three times below
    stored = F.when(full & F.col("address").isNotNull(), F.struct(F.col("record_id").alias("id"), F.col("at").alias("at"), F.col("headers").alias("headers")))
    inside = W.partitionBy("address", "period").orderBy("at", "turn", "record_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    here = rows.withColumn("here", F.last(stored, ignorenulls=True).over(inside))
    latest = rows.where(full).groupBy("address", "period").agg(F.max_by(stored, F.struct("at", "record_id")).alias("latest"))
    spine = rows.select("address", "period").distinct().join(latest.withColumnRenamed("period", "p").withColumnRenamed("address", "a"), F.col("address").eqNullSafe(F.col("a")) & F.col("period").eqNullSafe(F.col("p")), "left")
    before = W.partitionBy("address").orderBy("period").rowsBetween(W.unboundedPreceding, -1)
    carried = spine.select(F.col("address").alias("a"), F.col("period").alias("p"), F.last("latest", ignorenulls=True).over(before).alias("before")).where("before IS NOT NULL")
    found = here.where("kind = 'revisit'").join(carried, (F.col("address") == F.col("a")) & F.col("period").eqNullSafe(F.col("p")), "left")
    found = found.withColumn("target", F.when(F.col("address").isNotNull(), F.coalesce("here", "before")))
    mine, theirs = F.col("headers"), F.col("target.headers")
    tags = (_etag(_header(mine, "etag")), _etag(_header(theirs, "etag")))
    dates = (_header(mine, "last-modified"), _header(theirs, "last-modified"))
    verdict = (F.when(F.col("target").isNull(), "unresolved").when(tags[0] != tags[1], "mismatch").when(tags[0] == tags[1], "confirmed")
               .when(dates[0] != dates[1], "mismatch").when(dates[0] == dates[1], "confirmed").otherwise("unverified"))
    allowed = F.map_filter(mine, lambda k, v: ~k.isin(*NOT_MERGED))
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~F.map_contains_key(allowed, k)), allowed)
    found = found.withColumn("verdict", verdict)
    return found.select("record_id", F.col("address").alias("canonical_url"), F.col("target.id").alias("refers_to"), (F.col("at") - F.col("target.at")).alias("age_seconds"), "verdict",
                        F.when(F.col("verdict").isin("confirmed", "unverified"), merged).alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """A capture log derived from ``pages``: each page is fetched once in full, and three times again.

    The log is a function of the row: times, answers (200 or 304), validators and
    headers follow from page_id and the page's bytes.
    """
    n = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n")
    rows = pages.select("page_id", "url", F.md5("html").alias("digest"), F.octet_length("html").alias("bytes"), n)
    kind = F.when((F.col("n") == 0) & (F.col("page_id") % 11 != 0), FULL).when((F.col("n") > 0) & ((F.col("page_id") + F.col("n")) % 4 == 0), FULL).otherwise(REVISIT)
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 12), F.when(F.col("page_id") % 13 == F.col("n"), "x").otherwise(""), F.lit('"'))
    etag = F.when(F.col("page_id") % 5 == 4, None).when((F.col("n") == 2), F.concat(F.lit("W/"), tag)).otherwise(tag)
    modified = F.when(F.col("page_id") % 10 != 9, F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string")))
    at = F.lit(1_700_000_000) + F.col("page_id") % 5000 * 60 + F.col("n") * 50_000
    everything = F.map_from_arrays(
        F.array(*map(F.lit, ("etag", "last-modified", "content-length", "cache-control", "date"))),
        F.array(etag, modified, F.when(F.col("n") == 0, F.col("bytes")).otherwise(0).cast("string"), F.concat(F.lit("max-age="), (F.col("n") * 60).cast("string")), at.cast("string")))
    return rows.select((F.col("page_id") * 4 + F.col("n")).alias("record_id"), "url", at.alias("captured"), kind.alias("kind"), F.map_filter(everything, lambda k, v: v.isNotNull()).alias("headers"))


# The same log and its resolution in DuckDB.
RESOLVE_SQL = r"""
WITH log AS (
  SELECT page_id, n, page_id * 4 + n AS record_id, url, 1700000000 + page_id % 5000 * 60 + n * 50000 AS moment,
    CASE WHEN n = 0 AND page_id % 11 <> 0 THEN 'response' WHEN n > 0 AND (page_id + n) % 4 = 0 THEN 'response' ELSE 'revisit' END AS kind,
    CASE WHEN page_id % 5 = 4 THEN NULL ELSE substr(md5(html), 1, 12) || CASE WHEN page_id % 13 = n THEN 'x' ELSE '' END END AS tag,
    CASE WHEN page_id % 5 <> 4 AND n = 2 THEN 'W/' ELSE '' END AS weak,
    CASE WHEN page_id % 10 <> 9 THEN 'day ' || CAST(page_id % 28 AS VARCHAR) END AS modified,
    CAST(CASE WHEN n = 0 THEN strlen(html) ELSE 0 END AS VARCHAR) AS size
  FROM pages, (SELECT unnest([0, 1, 2, 3]) AS n) AS visits
), parts AS (
  SELECT *, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?', 1) AS scheme,
    regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?', 2) AS host,
    regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?', 3) AS path,
    regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?', 4) AS query
  FROM log
), asked AS (
  SELECT *, list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[a-z]+|gclid|fbclid|ref|sessionid|phpsessid|jsessionid)='))) AS wanted
  FROM parts
), addressed AS (
  SELECT *, CASE WHEN lower(scheme) = 'https' THEN 'http' ELSE lower(scheme) END || '://' || CASE WHEN lower(scheme) = 'https' THEN regexp_replace(lower(host), '^(.*?)\.?(:443)?$', '\1') ELSE regexp_replace(lower(host), '^(.*?)\.?(:80)?$', '\1') END
    || regexp_replace(path, '/+$', '') || CASE WHEN len(wanted) > 0 THEN '?' || array_to_string(wanted, '&') ELSE '' END AS address
  FROM asked
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY address ORDER BY moment, CASE kind WHEN 'response' THEN 0 ELSE 1 END, record_id) AS place FROM addressed
), latest AS (
  SELECT *, max(CASE WHEN kind = 'response' THEN place END) OVER (PARTITION BY address ORDER BY place) AS target FROM ranked
), judged AS (
  SELECT r.*, s.record_id AS refers_to, r.moment - s.moment AS age_seconds, s.tag AS s_tag, s.weak AS s_weak, s.modified AS s_modified, s.size AS s_size, s.n AS s_n,
    CASE WHEN s.record_id IS NULL THEN 'unresolved' WHEN r.tag <> s.tag THEN 'mismatch' WHEN r.tag = s.tag THEN 'confirmed'
         WHEN r.modified <> s.modified THEN 'mismatch' WHEN r.modified = s.modified THEN 'confirmed' ELSE 'unverified' END AS verdict
  FROM latest r LEFT JOIN ranked s ON s.address = r.address AND s.place = r.target AND s.kind = 'response' WHERE r.kind = 'revisit'
)
SELECT record_id, address AS canonical_url, refers_to, CAST(age_seconds AS BIGINT) AS age_seconds, verdict,
  CASE WHEN verdict IN ('confirmed', 'unverified') THEN array_to_string(list_filter([
    'cache-control=max-age=' || CAST(n * 60 AS VARCHAR), 'content-length=' || s_size, 'date=' || CAST(moment AS VARCHAR),
    'etag=' || CASE WHEN tag IS NOT NULL THEN weak || '"' || tag || '"' ELSE s_weak || '"' || s_tag || '"' END,
    'last-modified=' || coalesce(modified, s_modified)], lambda x: x IS NOT NULL), ';') END AS headers
FROM judged
"""
