"""WARC: resolution of not-modified revisits.

A revisit says that a page had not changed since an earlier capture. It is joined as of its time to
the latest full response before it with the same canonical URL; the validators of both are checked,
and headers that a 304 may update are merged into the stored ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonolith.llm.common import cut, named

#: Captures of one URL that one task orders, about.
ROWS_PER_BUCKET = 1_000_000
#: Stretches of one URL, at most.
MOST_STRETCHES = 1024
# Headers of a 304 that do not replace those stored (RFC 9110 and 9111).
KEPT_HEADERS = (
    "connection", "content-encoding", "content-length", "content-range", "content-type",
    "keep-alive", "proxy-authenticate", "proxy-authorization", "te", "trailer", "transfer-encoding", "upgrade",
)
# Query parameters that only tell where a visitor came from.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "fbclid", "gclid")


def canonical_url(url: Column) -> Column:
    """Scheme http, host in lower case without www. and default port, no fragment, sorted query without tracking, no slash at the end."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
    named_ = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING))
    tail = F.array_join(F.array_sort(named_), "&")
    return F.concat(F.lit("http://"), host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(F.trim(tag), "^W/", "")


def merged_headers(stored: Column, update: Column) -> Column:
    """Stored headers with those that a 304 may update put in their place."""
    allowed = F.map_filter(F.coalesce(update, F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*KEPT_HEADERS))
    names = F.map_keys(allowed)
    return F.map_concat(F.map_filter(F.coalesce(stored, F.create_map().cast("map<string,string>")), lambda k, _: ~F.array_contains(names, k)), allowed)


def _stretched(rows: DataFrame, rows_per_bucket: int) -> DataFrame:
    """Adds stretch: for a URL with more captures than a task should order, which of its stretches of time a capture lies in; else 0.

    Such URLs are ``rows / rows_per_bucket`` at most, and so are their stretches, twice over.
    """
    hot = cut(rows.where(F.col("target_url").isNotNull() & F.col("ts").isNotNull()).groupBy("target_url").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_bucket))
    if hot.isEmpty():
        return rows.withColumn("stretch", F.lit(0))
    marks = F.percentile_approx("ts", [i / MOST_STRETCHES for i in range(1, MOST_STRETCHES)], 10 * MOST_STRETCHES)
    every = F.greatest(F.lit(1), F.floor(F.lit(MOST_STRETCHES) * rows_per_bucket / F.col("n"))).cast("int")
    told = rows.join(F.broadcast(hot), "target_url").groupBy("target_url").agg(marks.alias("marks"), F.first("n").alias("n"))
    edges = cut(told.select("target_url", F.array_distinct(F.filter("marks", lambda _, i: (i + 1) % every == 0)).alias("edges")))
    placed = rows.join(F.broadcast(edges), "target_url", "left")
    return placed.withColumn("stretch", F.coalesce(F.size(F.filter("edges", lambda e: e <= F.col("ts"))), F.lit(0))).drop("edges")


def resolve_revisits(records: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(record_id, target_url, response_id, status, headers) for each revisit.

    ``records``: record_id long, kind string (``response`` or ``revisit``; others are not looked
    at), url string, ts long, headers map<string,string> with names in lower case. The response is
    the latest strictly before the revisit, of those at one time the one with the greatest id.
    status: ``orphan`` (none earlier, or no url or time), ``mismatch`` (both have an ETag and they
    differ but for weakness, or neither pair of ETags and Last-Modified differs), ``unchecked``
    (no validator on both sides), ``resolved``. Headers are merged where resolved or unchecked, else
    the revisit's own. A URL with any share of the captures is cut into stretches of time, each
    ordered by a task, with the latest response of the stretches before carried over.
    Repeated rows give repeated rows; an empty table gives none; other columns are not looked at.
    """
    own = named(records, "record_id", "kind", "url", "ts", "headers")
    rows = own.select("record_id", "kind", canonical_url(F.col("url")).alias("target_url"), "ts", "headers").where(F.col("kind").isin("response", "revisit"))
    rows = _stretched(cut(rows), rows_per_bucket)
    usable = F.col("target_url").isNotNull() & F.col("ts").isNotNull()
    full = rows.where((F.col("kind") == "response") & usable).groupBy("target_url", "stretch", "ts").agg(F.max_by(F.struct("record_id", "headers"), "record_id").alias("full"))
    asked = rows.where((F.col("kind") == "revisit") & usable)
    line = full.select("target_url", "stretch", "ts", "full", F.lit(None).cast("bigint").alias("record_id"), F.lit(None).cast("map<string,string>").alias("headers")).unionByName(
        asked.select("target_url", "stretch", "ts", F.lit(None).cast(full.schema["full"].dataType).alias("full"), "record_id", "headers")
    )
    earlier = Window.partitionBy("target_url", "stretch").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    here = line.withColumn("own", F.last("full", True).over(earlier)).where(F.col("full").isNull()).drop("full")
    last = full.groupBy("target_url", "stretch").agg(F.max_by("full", "ts").alias("last"))
    carried = here.groupBy("target_url", "stretch").agg(F.lit(1).alias("asked")).join(last, ["target_url", "stretch"], "full")
    carried = carried.withColumn("carried", F.last("last", True).over(Window.partitionBy("target_url").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)))
    found = here.join(carried.select("target_url", "stretch", "carried"), ["target_url", "stretch"], "left").withColumn("full", F.coalesce("own", "carried"))
    homeless = rows.where((F.col("kind") == "revisit") & ~usable).select("record_id", "target_url", "headers", F.lit(None).cast(full.schema["full"].dataType).alias("full"))
    joined = found.select("record_id", "target_url", "headers", "full").unionByName(homeless)
    stored = F.col("full.headers")
    tag, tag0 = _weak(F.col("headers")["etag"]), _weak(stored["etag"])
    date, date0 = F.col("headers")["last-modified"], stored["last-modified"]
    status = (
        F.when(F.col("full").isNull(), "orphan")
        .when(tag.isNotNull() & tag0.isNotNull(), F.when(tag == tag0, "resolved").otherwise("mismatch"))
        .when(date.isNotNull() & date0.isNotNull(), F.when(date == date0, "resolved").otherwise("mismatch"))
        .otherwise("unchecked")
    )
    out = joined.withColumn("status", status)
    good = F.col("status").isin("resolved", "unchecked")
    return out.select(
        "record_id", "target_url", F.col("full.record_id").alias("response_id"), "status",
        F.when(good, merged_headers(stored, F.col("headers"))).otherwise(F.col("headers")).alias("headers"),
    )


def header_lines(headers: Column) -> Column:
    """``name: value`` lines in order of name."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))), "\n")
