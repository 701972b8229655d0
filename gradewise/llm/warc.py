"""Resolution of WARC revisit records of the not-modified kind.

A revisit says that a page had not changed since an earlier capture. Records are brought to a
canonical URL, and an as-of join finds the latest full response of that URL that was captured before
the revisit. Its validators must agree with the revisit's (entity tags by weak comparison, else the
last-modified date); then the revisit gets its payload, and its headers with those that a
not-modified response may change.

The as-of join has three levels: within a URL's records of one minute, over the last responses of the
minutes of a day, and over those of its days. So a URL that holds a large share of all records is split
by time. Only ids and times take part in it. Payloads are joined by record id afterwards, those of
resolved revisits only; a response that very many revisits resolve to is dealt out in copies, one for
each ``HOT`` revisits.

Defined results: a null URL or time has no earlier response; a response captured at the same moment
is not earlier; of two responses captured at one moment the one with the larger id is later;
without a validator on both sides the outcome is ``no_validator``; repeated rows each give a row, and
of responses that share an id the one with the earliest time, then the smallest URL and payload
digest counts, for all their revisits; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradewise.llm.common import cut, table

#: Seconds of the spans of time of the as-of join, from the shortest.
SPANS = (60, 24 * 3600)
#: Revisits of one response that share a copy of its payload.
HOT = 10_000
#: Most targets of more than that which are broadcast.
BROADCAST_TARGETS = 1_000_000
#: Query parameters that don't change what a URL gives.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$"
#: Headers of a not-modified response that say nothing about the stored one.
KEPT_FROM_STORED = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
    "content-length", "content-encoding", "content-type", "content-range",
)


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default port, path without a last slash, query without
    tracking parameters and in order; no scheme and no fragment. What has no ``://`` stays as it is."""
    part = lambda i: F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(\?[^#]*)?", i)
    host = F.regexp_replace(F.regexp_replace(F.lower(part(1)), r"^www\.", ""), r":(80|443)$", "")
    kept = F.array_sort(F.filter(F.split(F.substring(part(3), 2, 1 << 30), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    query = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.concat(host, F.regexp_replace(part(2), "/+$", ""), query)).otherwise(url)


def _tag(header: Column) -> Column:
    return F.regexp_replace(header, "^W/", "")


def latest_earlier(records: DataFrame) -> DataFrame:
    """(record_id, target_id): the latest full response of the same URL before each revisit."""
    micros = F.unix_micros("captured_at")
    events = records.select("record_id", canonical_url(F.col("url")).alias("site"), micros.alias("at"), (F.col("kind") == "response").alias("full")).where("site IS NOT NULL AND at IS NOT NULL")
    events = events.select("*", *[F.floor(F.col("at") / F.lit(s * 1_000_000)).alias(f"span{i}") for i, s in enumerate(SPANS)])
    last = F.max(F.when(F.col("full"), F.struct("at", "record_id")))
    within = Window.partitionBy("site", "span0").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    out = events.withColumn("near0", last.over(within)).where(~F.col("full"))
    lasts = events.groupBy("site", "span0", "span1").agg(last.alias("last"))
    for i in range(len(SPANS)):
        around = ["site", f"span{i + 1}"] if i + 1 < len(SPANS) else ["site"]
        before = Window.partitionBy(*around).orderBy(f"span{i}").rowsBetween(Window.unboundedPreceding, -1)
        key = ["site", *[f"span{j}" for j in range(i, len(SPANS))]]
        carried = lasts.select(*key, F.max("last").over(before).alias(f"near{i + 1}"))
        out = out.join(carried, key, "left")
        if i + 1 < len(SPANS):
            lasts = lasts.groupBy(*key[:1], *key[2:]).agg(F.max("last").alias("last"))
    # What is nearer in time is later.
    return out.select("record_id", F.coalesce(*[f"near{i}.record_id" for i in range(len(SPANS) + 1)]).alias("target_id"))


def resolve(records: DataFrame) -> DataFrame:
    """record_id, target_id, outcome, payload, headers of each revisit of ``records`` (record_id,
    url, captured_at, kind: response or revisit, headers map of lower-case names, payload).

    outcome: resolved, mismatch, no_validator or no_response; payload and headers only if resolved.
    """
    revisits = records.where(F.col("kind") == "revisit").select("record_id", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("sent"))
    responses = records.where(F.col("kind") == "response").select(F.col("record_id").alias("target_id"), "captured_at", "url", "headers", "payload")
    if not responses.groupBy("target_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # Of responses that share an id one counts; what is equal in time, URL and payload is one.
        rank = F.struct("captured_at", "url", F.xxhash64("payload"))
        first = responses.groupBy("target_id").agg(F.min(rank).alias("first"))
        responses = responses.join(first, "target_id").where(rank == F.col("first")).drop("first").dropDuplicates(["target_id"])
    stored = responses.select("target_id", F.col("headers").alias("stored"))
    found = revisits.join(latest_earlier(records).dropDuplicates(["record_id"]), "record_id", "left").join(stored, "target_id", "left")
    etags, dates = ([F.col(side)[name] for side in ("sent", "stored")] for name in ("etag", "last-modified"))
    agree = F.coalesce(_tag(etags[0]) == _tag(etags[1]), dates[0] == dates[1])
    outcome = F.when(F.col("target_id").isNull(), "no_response").when(agree, "resolved").when(~agree, "mismatch").otherwise("no_validator")
    permitted = F.map_filter("sent", lambda k, _: ~k.isin(*KEPT_FROM_STORED))
    merged = F.map_concat(F.map_filter("stored", lambda k, _: ~F.map_contains_key(permitted, k)), permitted)
    judged = cut(found.select("record_id", "target_id", outcome.alias("outcome"), merged.alias("merged")))
    good = judged.where("outcome = 'resolved'")
    hot = cut(good.groupBy("target_id").agg((F.floor(F.count("*") / HOT) + 1).alias("copies")).where("copies > 1"))
    # Where the hot targets are few enough to be sent along, payloads are shuffled once.
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_TARGETS else hot
    copies = F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)).cast("int") - 1)
    payloads = responses.select("target_id", "payload").join(hot, "target_id", "left").select("target_id", F.explode(copies).alias("copy"), "payload")
    dealt = good.join(hot, "target_id", "left").withColumn("copy", F.pmod(F.xxhash64("record_id"), F.coalesce("copies", F.lit(1))).cast("int"))
    resolved = dealt.join(payloads, ["target_id", "copy"], "left").select("record_id", "target_id", "outcome", "payload", F.col("merged").alias("headers"))
    none = judged.where("outcome <> 'resolved'").select("record_id", "target_id", "outcome", F.lit(None).cast(records.schema["payload"].dataType).alias("payload"), F.lit(None).cast("map<string,string>").alias("headers"))
    return resolved.unionByName(none)


def _members(content: bytes) -> Iterator[bytes]:
    """The text of a WARC file, member by member where it is compressed."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    while content[:2] == b"\x1f\x8b":
        one = zlib.decompressobj(31)
        yield one.decompress(content)
        content = one.unused_data


def _fields(block: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in block.split(b"\r\n")[1:] if b":" in line)
    return {k.strip().lower().decode("latin-1"): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def warc_records(content: bytes) -> Iterator[tuple]:
    """(record_id, url, time, kind, headers, payload) of a file's responses and not-modified revisits."""
    for text in _members(content):
        at = 0
        while (start := text.find(b"WARC/", at)) >= 0 and (end := text.find(b"\r\n\r\n", start)) >= 0:
            own = _fields(text[start:end])
            size = int(own.get("content-length", "0") or 0)
            body, at = text[end + 4 : end + 4 + size], end + 4 + size
            kind = own.get("warc-type", "")
            if kind != "response" and not (kind == "revisit" and own.get("warc-profile", "").rstrip("/").endswith("server-not-modified")):
                continue
            head, _, payload = body.partition(b"\r\n\r\n")
            yield own.get("warc-record-id"), own.get("warc-target-uri"), own.get("warc-date"), kind, [*_fields(head).items()], payload.decode("utf-8", "replace") if kind == "response" else None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, compressed or not, as ``resolve`` takes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = list(zip(*warc_records(content.as_py()), strict=True))
                if rows:
                    kinds = [pa.string()] * 4 + [pa.map_(pa.string(), pa.string()), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], names=["record_id", "url", "time", "kind", "headers", "payload"])

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "record_id string, url string, time string, kind string, headers map<string,string>, payload string").withColumn("captured_at", F.to_timestamp("time")).drop("time")


#: The captures of a page of ``crawl_of``: number, kind, hours after the page's time, the version that it
#: has or asks for, its validators, and the pages that have it.
CAPTURES = [
    (0, "response", 0, 1, "tag", "true"),
    (1, "revisit", 168, 1, "weak", "true"),
    (2, "response", 192, 2, "tag", "page_id % 3 = 0"),
    (3, "revisit", 216, 1, "weak", "true"),
    (4, "revisit", -1, 1, "weak", "page_id % 2 = 0"),
    (5, "revisit", 240, 1, "none", "page_id % 4 = 0"),
    (6, "revisit", 240, 1, "date", "page_id % 4 = 1"),
    (7, "response", 216, 3, "tag", "page_id % 5 = 0"),
]


def crawl_of(pages: DataFrame) -> DataFrame:
    """A crawl's records, with a history for each page, pages a minute apart: a full response, revisits
    before it, a week later, and after the page has changed on some, with a strong or weak tag, a date
    alone, or no validator, and a response at the very moment of a revisit."""
    # Only the number of a capture is exploded, so that a scan that needs ids and times reads no text.
    k = F.explode(F.array_compact(F.array(*[F.when(F.expr(some), F.lit(number)) for number, *_, some in CAPTURES])))
    rows = pages.select("page_id", "url", "html", k.alias("k"))

    def by_capture(value) -> Column:
        return reduce(lambda rest, c: F.when(F.col("k") == c[0], value(*c[1:5])).otherwise(rest), CAPTURES[1:], value(*CAPTURES[0][1:5]))

    digest, page = F.substring(F.md5(F.col("html")), 1, 16), F.col("page_id").cast("string")
    text = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    version = by_capture(lambda kind, hours, v, validator: F.lit(v))
    mark = F.when(version == 1, "").otherwise(F.concat(F.lit("<!--"), version.cast("string"), F.lit("-->")))
    tag = F.concat(F.lit('"'), digest, F.lit("-"), version.cast("string"), F.lit('"'))
    date = F.concat(F.lit("v"), version.cast("string"), F.lit(" "), page)
    full = text("content-type", "text/html", "content-length", (F.octet_length("html") + F.octet_length(mark)).cast("string"), "etag", tag, "last-modified", date, "server", "a")
    asks = {"weak": text("etag", F.concat(F.lit("W/"), tag)), "date": text("last-modified", date), "none": F.create_map().cast("map<string,string>")}
    has = by_capture(lambda kind, hours, v, validator: F.lit(validator))
    sent = F.map_concat(text("content-length", "0", "connection", "close", "cache-control", "max-age=60"), F.when(has == "weak", asks["weak"]).when(has == "date", asks["date"]).otherwise(asks["none"]))
    kind = by_capture(lambda kind, hours, v, validator: F.lit(kind))
    at = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("page_id") * 60 + by_capture(lambda kind, hours, v, validator: F.lit(hours)) * 3600)
    return rows.select("url", (F.col("page_id") * 10 + F.col("k")).alias("record_id"), at.alias("captured_at"), kind.alias("kind"), F.when(kind == "response", full).otherwise(sent).alias("headers"), F.when(kind == "response", F.concat("html", mark)).alias("payload"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(crawl_of(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return found.select("record_id", "target_id", "outcome", F.sha2(F.col("payload"), 256).alias("payload_sha256"), headers.alias("headers"))


_PARTS = r"'^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)(\?[^#]*)?'"
_RECORDS = " UNION ALL ".join(
    f"SELECT page_id * 10 + {n} AS id, site, moment + {h * 3600} AS moment, {kind == 'response'} AS full, {v} AS version, '{has}' AS has, page_id, html, tag FROM s WHERE {some}" for n, kind, h, v, has, some in CAPTURES
)
ORACLE = rf"""
WITH p AS (
  SELECT page_id, html, md5(html)[1:16] AS tag, page_id * 60 AS moment,
    regexp_replace(regexp_replace(lower(regexp_extract(url, {_PARTS}, 1)), '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(url, {_PARTS}, 2), '/+$', '') AS place,
    list_sort(list_filter(string_split(substring(regexp_extract(url, {_PARTS}, 3), 2), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=.*)?$'))) AS args
  FROM pages),
s AS (SELECT page_id, html, tag, moment, place || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS site FROM p),
r AS ({_RECORDS}),
t AS (SELECT q.id, arg_max(c.id, (c.moment, c.id)) AS target FROM r q JOIN r c ON c.site = q.site AND c.full AND NOT q.full AND c.moment < q.moment GROUP BY q.id),
j AS (SELECT q.*, c.id AS target_id, c.html AS stored, c.version AS stored_version, c.tag AS stored_tag, c.page_id AS stored_page,
    CASE WHEN c.id IS NULL THEN 'no_response' WHEN q.has = 'weak' THEN CASE WHEN q.tag = c.tag AND q.version = c.version THEN 'resolved' ELSE 'mismatch' END
      WHEN q.has = 'date' THEN CASE WHEN q.page_id = c.page_id AND q.version = c.version THEN 'resolved' ELSE 'mismatch' END ELSE 'no_validator' END AS outcome
  FROM r q LEFT JOIN t ON t.id = q.id LEFT JOIN r c ON c.id = t.target WHERE NOT q.full),
k AS (SELECT *, stored || CASE WHEN stored_version = 1 THEN '' ELSE '<!--' || stored_version || '-->' END AS body FROM j)
SELECT id AS record_id, target_id, outcome, CASE WHEN outcome = 'resolved' THEN sha256(body) END AS payload_sha256,
  CASE WHEN outcome = 'resolved' THEN 'cache-control: max-age=60' || chr(10) || 'content-length: ' || strlen(body) || chr(10) || 'content-type: text/html' || chr(10)
    || CASE WHEN has = 'weak' THEN 'etag: W/"' || tag || '-' || version || '"' ELSE 'etag: "' || stored_tag || '-' || stored_version || '"' END || chr(10) || 'last-modified: v' || stored_version || ' ' || stored_page || chr(10) || 'server: a' END AS headers
FROM k
"""

QUERIES = {"op7_warc_revisits": op7_warc_revisits}
ORACLES = {"op7_warc_revisits": ORACLE}
