"""Not-modified revisits of a web archive, resolved by an as-of join (operator 8).

A revisit record says that a page had not changed. It is resolved by the latest earlier full response
of the same canonical URL, if the validators agree: the entity tag (compared weakly), else the time of
last modification. The resolved record has the response's headers, updated by those of the revisit
that a not-modified answer may change.

As-of join: time is cut into slots. Within a slot, a running maximum finds the latest earlier
response; before it, a running maximum over one row per URL and slot does. So a URL with a third of all
captures is cut into slots, and no task holds its history.

Scale: one shuffle by (URL, slot) of records without payloads, one of a row per URL and slot, and their
join. Nothing is collected or broadcast.

Defined cases: null url, time or no earlier response: unresolved (``no_response``); validators that
disagree: ``mismatch``; a revisit without validators: ``unverified``, and resolved by the latest
response; several responses at one time: the largest record id counts, and one at the revisit's own
time is not earlier; null headers: as none; repeated rows are each returned; empty table: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a slot.
SLOT = 3_600

#: Headers that a not-modified answer does not change: they describe the transfer or the stored body.
FIXED_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
    "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)

#: Query parameters that do not name a page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"

_URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def canonical(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without closing slashes, other parameters sorted."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 2), r"/+$", "")
    params = F.filter(F.split(F.regexp_extract(url, _URL, 3), "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    query = F.array_join(F.array_sort(params), "&")
    full = F.concat(host, path, F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)))
    return F.when(url.rlike(_URL), full)


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame, slot: int = SLOT) -> DataFrame:
    """Every revisit with what it refers to.

    ``records``: ``record_id``, ``url``, ``ts`` (seconds), ``kind`` (``response`` or ``revisit``), ``etag``,
    ``modified`` and ``headers`` (a map by lower-case name). Result: ``record_id``, ``canonical_url``, ``ts``,
    ``refers_to`` (record id, null if unresolved), ``status`` (``etag``, ``modified``, ``unverified``, ``mismatch``,
    ``no_response``) and ``headers``.
    """
    rows = records.select("record_id", canonical(F.col("url")).alias("canonical_url"), "ts", "kind", "etag", "modified", "headers")
    rows = rows.withColumn("slot", F.floor(F.col("ts") / slot))
    full = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "modified", F.to_json("headers").alias("headers")))
    rows = rows.withColumn("full", F.when(F.col("canonical_url").isNotNull() & F.col("ts").isNotNull(), full))
    inside = Window.partitionBy("canonical_url", "slot").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("canonical_url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = rows.groupBy("canonical_url", "slot").agg(F.max("full").alias("last"))
    slots = slots.select("canonical_url", "slot", F.max("last").over(before).alias("carried"))
    # revisits that cannot be resolved are spread over their ids, not gathered under null
    lost = F.col("canonical_url").isNull() | F.col("ts").isNull()
    near = rows.where(~lost).withColumn("own", F.max("full").over(inside)).where("kind = 'revisit'")
    near = near.join(slots.where("canonical_url is not null and slot is not null"), ["canonical_url", "slot"])
    found = near.withColumn("hit", F.coalesce("own", "carried")).drop("own", "carried")
    found = found.unionByName(rows.where(lost & (F.col("kind") == "revisit")), allowMissingColumns=True)

    tag, time = F.col("etag"), F.col("modified")
    status = (
        F.when(F.col("hit").isNull(), "no_response")
        .when(tag.isNotNull(), F.when(_weak(tag) == _weak(F.col("hit.etag")), "etag").otherwise("mismatch"))
        .when(time.isNotNull(), F.when(time == F.col("hit.modified"), "modified").otherwise("mismatch"))
        .otherwise("unverified")
    )
    found = found.withColumn("status", status)
    good = F.col("status").isin("etag", "modified", "unverified")
    none = F.create_map().cast("map<string,string>")
    own = F.map_filter(F.coalesce("headers", none), lambda k, v: ~k.isin(*FIXED_HEADERS))
    stored = F.coalesce(F.from_json("hit.headers", "map<string,string>"), none)
    merged = F.map_concat(F.map_filter(stored, lambda k, v: ~F.array_contains(F.map_keys(own), k)), own)
    return found.select(
        "record_id", "canonical_url", "ts",
        F.when(good, F.col("hit.record_id")).alias("refers_to"), "status",
        F.when(good, merged).otherwise(F.coalesce("headers", none)).alias("headers"),
    )


#: The crawl that is derived from the pages table starts then; a capture every so many seconds.
START, EVERY = 1_704_067_200, 7


def crawl(pages: DataFrame) -> DataFrame:
    """Records of a crawl of the given pages: a full response of each, and a later revisit.

    By ``page_id mod 11``, some revisits have a changed tag, a weak one, a time only, or no validator.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("p"), "url", F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("t", START + F.col("p") * EVERY).withColumn("tag", F.concat(F.lit('"'), F.substring(F.md5(F.col("html").cast("binary")), 1, 16), F.lit('"')))
    rows = rows.withColumn("m", (F.col("t") - F.col("p") % 1000).cast("string")).withColumn("n", F.octet_length("html").cast("string")).drop("html")

    def headers(**values: Column) -> Column:
        pairs = [x for k, v in values.items() for x in (F.lit(k.replace("_", "-")), v)]
        return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())

    response = rows.select(
        (F.col("p") * 2).alias("record_id"), "url", F.col("t").alias("ts"), F.lit("response").alias("kind"), F.col("tag").alias("etag"), F.col("m").alias("modified"),
        headers(cache_control=F.lit("max-age=60"), content_length=F.col("n"), content_type=F.lit("text/html"), date=F.col("t").cast("string"), etag=F.col("tag"), last_modified=F.col("m")).alias("headers"),
    )
    kind = F.col("p") % 11
    later = F.col("t") + 1 + F.col("p") * 37 % 5000
    tag = F.when(kind == 0, F.concat(F.lit('"new-'), F.col("p").cast("string"), F.lit('"'))).when(kind == 2, F.concat(F.lit("W/"), F.col("tag")))
    tag = tag.when(kind.isin(1, 3), F.lit(None)).otherwise(F.col("tag"))
    time = F.when(kind == 3, F.lit(None)).otherwise(F.col("m"))
    revisit = rows.select(
        (F.col("p") * 2 + 1).alias("record_id"), "url", later.alias("ts"), F.lit("revisit").alias("kind"), tag.alias("etag"), time.alias("modified"),
        headers(cache_control=F.concat(F.lit("max-age="), (F.col("p") % 5 * 60).cast("string")), content_length=F.lit("0"), date=later.cast("string"), etag=tag, expires=(later + 60).cast("string")).alias("headers"),
    )
    return response.unionByName(revisit)


def resolved(pages: DataFrame) -> DataFrame:
    """The revisits of a crawl of ``pages``, resolved; headers as sorted ``name: value`` lines."""
    out = resolve(crawl(pages))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))
    return out.select("record_id", "canonical_url", "ts", F.coalesce("refers_to", F.lit(-1)).alias("refers_to"), "status", F.array_join(lines, "\n").alias("headers"))


SQL = rf"""
WITH base AS (SELECT page_id AS p, url, coalesce(html, '') AS html, {START} + page_id * {EVERY} AS t FROM pages),
rows AS (SELECT p, url, t, '"' || substr(md5(html), 1, 16) || '"' AS tag, CAST(t - p % 1000 AS VARCHAR) AS m, CAST(strlen(html) AS VARCHAR) AS n FROM base),
parts AS (SELECT *, regexp_extract(url, '{_URL}', ['host', 'path', 'query']) AS u, regexp_matches(url, '{_URL}') AS ok FROM rows),
named AS (
  SELECT *, CASE WHEN ok THEN regexp_replace(lower(u.host), '^www\.|:(80|443)$', '', 'g') || regexp_replace(u.path, '/+$', '')
                 || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END END AS c
  FROM (SELECT *, list_sort(list_filter(string_split(u.query, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))) AS q FROM parts)),
response AS (SELECT p * 2 AS id, c, t AS ts, tag, m, n, t FROM named),
revisit AS (
  SELECT p * 2 + 1 AS id, c, t + 1 + p * 37 % 5000 AS ts, p,
         CASE p % 11 WHEN 0 THEN '"new-' || p || '"' WHEN 2 THEN 'W/' || tag WHEN 1 THEN NULL WHEN 3 THEN NULL ELSE tag END AS tag,
         CASE p % 11 WHEN 3 THEN NULL ELSE m END AS m
  FROM named),
hit AS (SELECT v.id, v.ts, arg_max(r, (r.ts, r.id)) AS r FROM (SELECT DISTINCT id, c, ts FROM revisit) v JOIN response r ON r.c = v.c AND r.ts < v.ts GROUP BY v.id, v.ts),
found AS (
  SELECT v.*, h.r, CASE WHEN h.r IS NULL THEN 'no_response'
      WHEN v.tag IS NOT NULL THEN CASE WHEN regexp_replace(v.tag, '^W/', '') = h.r.tag THEN 'etag' ELSE 'mismatch' END
      WHEN v.m IS NOT NULL THEN CASE WHEN v.m = h.r.m THEN 'modified' ELSE 'mismatch' END ELSE 'unverified' END AS status
  FROM revisit v LEFT JOIN hit h ON h.id = v.id AND h.ts = v.ts),
good AS (SELECT *, status IN ('etag', 'modified', 'unverified') AS ok FROM found)
SELECT id AS record_id, c AS canonical_url, ts, CASE WHEN ok THEN r.id ELSE -1 END AS refers_to, status,
  'cache-control: max-age=' || (p % 5 * 60)
  || chr(10) || 'content-length: ' || CASE WHEN ok THEN r.n ELSE '0' END
  || CASE WHEN ok THEN chr(10) || 'content-type: text/html' ELSE '' END
  || chr(10) || 'date: ' || ts
  || coalesce(chr(10) || 'etag: ' || coalesce(tag, CASE WHEN ok THEN r.tag END), '')
  || chr(10) || 'expires: ' || (ts + 60)
  || CASE WHEN ok THEN chr(10) || 'last-modified: ' || r.m ELSE '' END AS headers
FROM good
"""
