"""WARC not-modified revisits: each gets the latest earlier full response of its canonical URL.

The as-of join carries slim rows only. Time is cut into slots; the last response of each (URL, slot) is found by an
aggregate, carried over the slots of a URL (one row a slot), and inside a slot by a window. So a URL that holds a third of all
records is spread over its slots. Validators decide whether the response is the one that was not modified; then
headers that a 304 may update are merged into it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a slot.
SLOT = 3600
# Headers that a 304 response may bring up to date (RFC 9110, 15.4.5; RFC 9111, 3.2).
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
# Query parameters that only track visitors.
TRACKING = ["ref", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid"]
HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, no tracking parameters, others sorted, path at least /.

    A text that is no absolute URL is only trimmed; null stays null.
    """
    url = F.regexp_replace(F.trim(url), "#.*$", "")
    part = lambda i: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)(?:\?(.*))?$", i)
    scheme, host = F.lower(part(1)), F.lower(part(2))
    host = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(
        scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    path = F.when(part(3) == "", "/").otherwise(part(3))
    query = F.array_sort(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.array_contains(
        F.array(*[F.lit(t) for t in TRACKING]), F.lower(F.substring_index(p, "=", 1)))))
    tail = F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise("")
    return F.when(scheme == "", url).otherwise(F.concat(scheme, F.lit("://"), host, path, tail))


def header(headers: Column, name: str) -> Column:
    """First value of a header, whatever the case of its name."""
    return F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers, where those that the 304 carries and may update take its values; names in lower case, sorted."""
    lowered = lambda hs: F.transform(F.coalesce(hs, F.array().cast(HEADERS)), lambda h: F.struct(
        F.lower(h["name"]).alias("name"), h["value"].alias("value")))
    allowed = F.array(*[F.lit(p) for p in PERMITTED])
    news = F.filter(lowered(update), lambda h: F.array_contains(allowed, h["name"]))
    named = F.transform(news, lambda h: h["name"])
    return F.sort_array(F.concat(F.filter(lowered(stored), lambda h: ~F.array_contains(named, h["name"])), news))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def _once(records: DataFrame) -> DataFrame:
    """Each record once, under a name of its own (_record)."""
    content = F.struct("url", F.col("at").cast("timestamp").alias("at"), "headers", "payload_digest")
    name = F.when(F.col("record_id").isNull(), F.md5(F.concat(F.col("kind"), F.to_json(content)))).otherwise(
        F.concat(F.col("kind"), F.lit(" "), F.col("record_id").cast("string")))
    rows = records.filter(F.col("kind").isin("response", "revisit")).select("record_id", "kind", name.alias("_record"), content.alias("_c"))
    return rows.groupBy("_record", "record_id", "kind").agg(F.min("_c").alias("_c")).select("_record", "record_id", "kind", "_c.*")


def resolve(records: DataFrame, slot: int = SLOT) -> DataFrame:
    """One row per revisit: record_id, url, at, response_id, response_at, outcome, payload_digest, headers.

    ``records``: record_id, url, at (timestamp), kind ('response' or 'revisit'), headers (name, value), payload_digest.
    Outcome: resolved; changed (validators differ: the response is not the one that was not modified); unproved (the
    304 has validators, the response none, or the other way round); no_response (no earlier one, or no URL or time).
    Only resolved rows get digest and headers. Equal times do not count as earlier; of several responses at one time
    the largest record_id counts. Records of one kind and id are one, the smallest; records without id are one only if they are
    alike in everything. Weak and strong entity tags compare by their text. Extra columns are ignored.
    """
    records = _once(records)
    slim = records.select(
        "_record", "record_id", "kind", F.xxhash64(canonical_url(F.col("url"))).alias("u"), F.md5(canonical_url(F.col("url"))).alias("u2"),
        F.col("at").cast("timestamp").alias("at")).filter(F.col("kind").isin("response", "revisit"))
    slim = slim.withColumn("slot", F.floor(F.unix_micros("at") / (slot * 1_000_000)))
    known = slim.filter(F.col("u2").isNotNull() & F.col("at").isNotNull())
    key = ["u", "u2"]
    response = F.when(F.col("kind") == "response", F.struct("at", "record_id", "_record"))
    slots = known.groupBy(*key, "slot").agg(F.max(response).alias("last"))
    carried = slots.withColumn("before", F.last("last", ignorenulls=True).over(
        Window.partitionBy(*key).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    # All rows of a time see what came strictly before it: a range in microseconds.
    inside = Window.partitionBy(*key, "slot").orderBy(F.unix_micros("at")).rangeBetween(Window.unboundedPreceding, -1)
    found = (
        known.withColumn("here", F.max(response).over(inside)).filter(F.col("kind") == "revisit")
        .join(carried, [*key, "slot"], "left")
        .select("_record", F.coalesce("here", "before")["_record"].alias("_response"))
    )
    revisit = records.filter(F.col("kind") == "revisit").select("_record", "record_id", "url", "at", F.col("headers").alias("_new"))
    stored = records.filter(F.col("kind") == "response").select(
        F.col("_record").alias("_response"), F.col("record_id").alias("response_id"), F.col("at").alias("response_at"),
        F.col("headers").alias("_old"), F.col("payload_digest").alias("_digest"))
    rows = revisit.join(found, "_record", "left").join(stored, "_response", "left")
    tag_new, tag_old = _weak(header(F.col("_new"), "etag")), _weak(header(F.col("_old"), "etag"))
    day_new, day_old = F.trim(header(F.col("_new"), "last-modified")), F.trim(header(F.col("_old"), "last-modified"))
    validates = F.when(tag_new.isNotNull() & tag_old.isNotNull(), tag_new == tag_old).when(
        day_new.isNotNull() & day_old.isNotNull(), day_new == day_old)
    none = F.coalesce(tag_new, day_new, tag_old, day_old).isNull()
    outcome = (
        F.when(F.col("_response").isNull(), "no_response").when(validates | none, "resolved")
        .when(validates.isNull(), "unproved").otherwise("changed"))
    rows = rows.withColumn("outcome", outcome)
    good = F.col("outcome") == "resolved"
    return rows.select(
        "record_id", "url", "at", "response_id", "response_at", "outcome", F.when(good, F.col("_digest")).alias("payload_digest"),
        F.when(good, merged_headers(F.col("_old"), F.col("_new"))).alias("headers"))


def records_of_pages(pages: DataFrame) -> DataFrame:
    """Crawl records of a page table: a full response a page, and a later revisit that names the URL in another way.

    Times and validators follow from the page's number and text. Some revisits carry another entity tag, some no
    validator at all.
    """
    n = F.col("page_id")
    at = F.lit(1704067200) + F.pmod(n * 7919, F.lit(2592000))
    pair = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    present = lambda pairs: F.filter(F.array(*pairs), lambda h: h["value"].isNotNull())
    tag = F.when(n % 5 != 0, F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 12), F.lit('"')))
    day = F.when(n % 3 != 0, F.concat(F.lit("day "), (n % 30).cast("string")))
    date = lambda t: F.concat(F.lit("at "), t.cast("string"))
    responses = pages.select(
        (n * 2).alias("record_id"), F.col("url"), at.alias("s"), F.lit("response").alias("kind"), present([
            pair("Date", date(at)), pair("ETag", tag), pair("Last-Modified", day), pair("Cache-Control", F.lit("max-age=60")),
            pair("Content-Type", F.lit("text/html")), pair("Content-Length", F.length("html").cast("string"))]).alias("headers"),
        F.md5("html").alias("payload_digest"))
    later = at + (n % 97 + 1) * 3600
    written_as = F.when(n % 4 == 1, F.regexp_replace("url", "^http://", "HTTP://")).when(
        n % 4 == 2, F.concat("url", F.lit("#top"))).when(
        n % 4 == 3, F.concat("url", F.when(F.contains("url", F.lit("?")), "&").otherwise("?"), F.lit("utm_source=again"))).otherwise(
        F.col("url"))
    again = F.when(n % 7 == 0, F.lit('"other"')).when(n % 2 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    revisits = pages.select(
        (n * 2 + 1).alias("record_id"), written_as.alias("url"), later.alias("s"), F.lit("revisit").alias("kind"), present([
            pair("date", date(later)), pair("etag", F.when(n % 11 != 0, again)), pair("cache-control", F.lit("max-age=600")),
            pair("content-length", F.lit("0"))]).alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    return responses.unionByName(revisits).withColumn("at", F.timestamp_seconds("s")).drop("s")


_CANONICAL = r"""
  CASE WHEN regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1) = '' THEN {u} ELSE
    lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://'
    || CASE WHEN lower({u}) LIKE 'http://%' THEN regexp_replace(lower(regexp_extract({u}, '://([^/?]*)', 1)), ':80$', '')
         WHEN lower({u}) LIKE 'https://%' THEN regexp_replace(lower(regexp_extract({u}, '://([^/?]*)', 1)), ':443$', '')
         ELSE lower(regexp_extract({u}, '://([^/?]*)', 1)) END
    || coalesce(nullif(regexp_extract({u}, '://[^/?]*([^?]*)', 1), ''), '/')
    || CASE WHEN len({q}) > 0 THEN '?' || array_to_string({q}, '&') ELSE '' END END"""
_QUERY = (r"list_sort(list_filter(string_split(regexp_extract({u}, '\?(.*)$', 1), '&'), lambda p: p <> '' AND "
          r"lower(string_split(p, '=')[1]) NOT IN (" + ", ".join(f"'{t}'" for t in TRACKING) + ")))")
_U = "regexp_replace(trim(url), '#.*$', '')"

#: The same as SQL over the records of the page table.
SQL = rf"""
WITH base AS (
  SELECT page_id AS n, url, html, 1704067200 + (page_id * 7919) % 2592000 AS t,
    CASE WHEN page_id % 5 <> 0 THEN '"' || substr(md5(html), 1, 12) || '"' END AS tag,
    CASE WHEN page_id % 3 <> 0 THEN 'day ' || (page_id % 30) END AS day FROM pages),
response AS (
  SELECT n * 2 AS response_id, t, {_CANONICAL.format(u=_U, q=_QUERY.format(u=_U))} AS c, tag, day, md5(html) AS digest,
    length(html) AS size FROM base),
revisit AS (
  SELECT n * 2 + 1 AS record_id, t + (n % 97 + 1) * 3600 AS t,
    CASE n % 4 WHEN 1 THEN regexp_replace(url, '^http://', 'HTTP://') WHEN 2 THEN url || '#top'
      WHEN 3 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'utm_source=again' ELSE url END AS url,
    CASE WHEN n % 11 <> 0 THEN CASE WHEN n % 7 = 0 THEN '"other"' ELSE tag END END AS tag FROM base),
keyed AS (SELECT *, {_CANONICAL.format(u=_U, q=_QUERY.format(u=_U))} AS c FROM revisit),
found AS (
  SELECT v.record_id, v.t, v.tag AS new_tag, max({{'t': r.t, 'id': r.response_id}}) AS best
  FROM keyed v LEFT JOIN response r ON v.c = r.c AND r.t < v.t GROUP BY ALL),
judged AS (
  SELECT f.record_id, f.t, r.response_id, r.t AS response_at, new_tag, r.tag, r.day, r.digest, r.size,
    CASE WHEN r.response_id IS NULL THEN 'no_response'
      WHEN new_tag IS NOT NULL AND r.tag IS NOT NULL THEN CASE WHEN new_tag = r.tag THEN 'resolved' ELSE 'changed' END
      WHEN new_tag IS NULL AND r.tag IS NULL AND r.day IS NULL THEN 'resolved' ELSE 'unproved' END AS outcome,
    record_id // 2 AS n
  FROM found f LEFT JOIN response r ON f.best.id = r.response_id)
SELECT record_id, response_id, CAST(response_at AS BIGINT) AS response_at, outcome,
  CASE WHEN outcome = 'resolved' THEN digest END AS payload_digest,
  CASE WHEN outcome = 'resolved' THEN
    'cache-control: max-age=600|content-length: ' || size || '|content-type: text/html|date: at ' || t
    || coalesce('|etag: ' || CASE WHEN new_tag IS NULL THEN tag
         WHEN n % 7 <> 0 AND n % 2 = 0 THEN 'W/' || new_tag ELSE new_tag END, '')
    || coalesce('|last-modified: ' || day, '') END AS headers
FROM judged
"""
