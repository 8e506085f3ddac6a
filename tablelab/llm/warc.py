"""WARC: resolve not-modified revisits, in DataFrame functions only.

Each revisit record (an HTTP 304) belongs to the latest earlier full response of
the same canonical URL: an as-of join. The validators of the two are checked and
the headers that a 304 may update are merged into those of the response.

The as-of join is a running maximum over one URL's records in time order. A URL
with more than ``HOT`` records is cut at up to ``CUTS`` quantiles of its times;
each stretch is a window of its own, and the last response of the stretches
before it is carried in. So no URL is one task.

Defined cases: "earlier" means a smaller time, so a response of the same instant
is not used; of responses at one time the largest record id counts; a record
with a null URL or time is never matched; repeated rows stay; header names are
compared in lower case, null headers are none; an empty table gives an empty
result; columns that are not asked for are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

HOT, CUTS = 100_000, 256
#: The fields that a 304 response carries to update a stored one.
UPDATED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that only track where a visitor came from.
TRACKING = r"^(utm_[^=]*|ref|gclid|fbclid)(=.*)?$"

RESPONSE, REVISIT = "response", "revisit"
HEADERS = "array<struct<name:string,value:string>>"


def canonical_url(url: Column) -> Column:
    """Without scheme, default port, ``www.``, fragment, tracking parameters and closing slash; host in lower case, parameters sorted."""
    plain = F.regexp_replace(F.trim(url), r"#.*$", "")
    base = F.regexp_replace(F.substring_index(plain, "?", 1), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(base, "/", 1)), r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(F.substr(base, F.length(F.substring_index(base, "/", 1)) + 1, F.length(base)), r"/+$", "")
    query = F.when(F.instr(plain, "?") > 0, F.substr(plain, F.instr(plain, "?") + 1, F.length(plain))).otherwise("")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def resolve_revisits(
    records: DataFrame, id: str = "record_id", url: str = "url", at: str = "at", kind: str = "kind", etag: str = "etag",
    last_modified: str = "last_modified", headers: str = "headers", hot: int = HOT, cuts: int = CUTS,
) -> DataFrame:
    """One row a revisit: ``record_id``, ``url_key``, ``refers_to``, ``state``, ``headers``.

    ``at`` is a whole number (microseconds, a sequence). ``state`` is ``resolved``
    (validators agree), ``unverified`` (none to compare), ``conflict`` (they
    differ: the response is named, headers are not merged) or ``orphan`` (no
    earlier response). ``headers`` are the merged fields by name.
    """
    rows = records.select(
        F.col(id).alias("record_id"),
        canonical_url(F.col(url)).alias("url_key"),
        F.col(at).cast("long").alias("at"),
        F.col(kind).alias("kind"),
        F.col(etag).alias("etag"),
        F.col(last_modified).alias("last_modified"),
        F.coalesce(
            F.transform(F.col(headers), lambda h: F.struct(F.lower(h["name"]).alias("name"), h["value"].alias("value"))),
            F.array().cast(HEADERS),
        ).alias("headers"),
    ).filter(F.col("kind").isin(RESPONSE, REVISIT))
    placed = F.col("url_key").isNotNull() & F.col("at").isNotNull()
    lost = rows.filter(~placed & (F.col("kind") == REVISIT))
    rows = rows.filter(placed)

    shares = F.array(*[F.lit(i / cuts) for i in range(1, cuts)])
    busy = rows.groupBy("url_key").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("url_key")
    times = rows.select("url_key", "at").join(busy, "url_key").groupBy("url_key")
    times = times.agg(F.array_distinct(F.percentile_approx("at", shares, F.lit(10_000))).alias("cuts"))
    rows = rows.join(times, "url_key", "left")
    stretch = F.coalesce(F.size(F.filter("cuts", lambda c: c <= F.col("at"))), F.lit(0))
    rows = rows.withColumn("stretch", F.when(F.col("cuts").isNull(), 0).otherwise(stretch)).drop("cuts")

    response = F.struct("at", "record_id", "etag", "last_modified", "headers")
    inside = Window.partitionBy("url_key", "stretch").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("found", F.max(F.when(F.col("kind") == RESPONSE, response)).over(inside)).filter(F.col("kind") == REVISIT)
    ends = rows.join(busy, "url_key", "left_semi").groupBy("url_key", "stretch")
    ends = ends.agg(F.max(F.when(F.col("kind") == RESPONSE, response)).alias("end"))
    earlier = Window.partitionBy("url_key").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("url_key", "stretch", F.max("end").over(earlier).alias("carried"))
    found = found.join(ends, ["url_key", "stretch"], "left").withColumn("r", F.coalesce("found", "carried")).drop("found", "carried", "stretch")
    found = found.unionByName(lost.withColumn("r", F.lit(None).cast(found.schema["r"].dataType)))

    def strong(tag: Column) -> Column:
        return F.regexp_replace(tag, r"^W/", "")

    tags = F.col("etag").isNotNull() & F.col("r.etag").isNotNull()
    dates = F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull()
    agree = F.when(tags, strong(F.col("etag")) == strong(F.col("r.etag"))).when(dates, F.col("last_modified") == F.col("r.last_modified"))
    state = F.when(F.col("r").isNull(), "orphan").when(agree, "resolved").when(~agree, "conflict").otherwise("unverified")
    new = F.filter("headers", lambda h: h["name"].isin(*UPDATED))
    names = F.transform(new, lambda h: h["name"])
    old = F.filter("r.headers", lambda h: ~F.array_contains(names, h["name"]))
    merged = F.when(F.col("state").isin("resolved", "unverified"), F.array_sort(F.concat(old, new)))
    return found.withColumn("state", state).select(
        "record_id", "url_key", F.col("r.record_id").alias("refers_to"), "state", merged.alias("headers")
    )
