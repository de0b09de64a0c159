"""WARC captures: resolution of not-modified revisits.

A revisit record says that the server answered 304 and holds no body.  It is resolved by an as-of join: the latest
earlier full response of the same canonical URL, whose validators must agree, lends its body and its headers, the
latter updated by those that a 304 answer may carry.

The as-of join is two levels of windows over slim columns.  Records are cut by range of (URL, time, id) into slots of
about equal size; within (URL, slot) a window finds the last response, and what earlier slots hand on is one row per
(URL, slot).  So a URL that fills a third of the table is spread over many slots whatever its times are, and bodies move
only in the final equi-join on the response's id.

Defined cases: among records of one time the smaller id is the earlier; a record without URL or time is never
resolved and never resolves another; a revisit without validators, or whose validator the response lacks, does not
match; header names compare without case; null headers count as none; repeated ids are repeated records, and a
response whose id repeats lends the body that compares largest; records of any other kind, or without one, come out as
they are with the status ``other``; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixspark.plans.scratch import keep

#: Header fields that a 304 answer updates (RFC 9110, 15.4.5, and the dates of RFC 9111, 3.2).
NOT_MODIFIED_HEADERS = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, ``m.`` and default port, path without trailing slash, query without
    tracking parameters and in sorted order; scheme and fragment do not count."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"#.*$", ""), r"(?i)^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"(?i)^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def lower_keys(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the value that compares largest stays."""
    none = F.create_map().cast("map<string,string>")
    entries = F.array_sort(F.transform(F.map_entries(F.coalesce(headers, none)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    last = F.filter(entries, lambda e, i: (i == F.size(entries) - 1) | (F.get(entries, i + 1)["key"] != e["key"]))
    return F.map_from_entries(last)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Resolve a table ``record_id, url, ts (long), kind ('response'|'revisit'), headers map<string,string>, body``.

    Returns one row per record: ``record_id, url_key, ts, kind, status, refers_to, headers, body``.  ``status`` is
    ``response``, ``resolved``, ``no_response``, ``validator_mismatch`` or ``other``; unresolved revisits have a null body
    and their own headers.
    """
    src = records.select("record_id", canonical_url(F.col("url")).alias("url_key"), "ts", "kind", lower_keys(F.col("headers")).alias("headers"), "body")
    sound = F.col("url_key").isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    meta = src.select("record_id", "url_key", "ts", "kind", "headers").where("kind in ('response', 'revisit')")
    asof = _latest_response(
        meta.where(sound).select(
            "record_id", "url_key", "ts", "kind", F.col("headers").getItem("etag").alias("etag"), F.col("headers").getItem("last-modified").alias("modified"),
            F.when(F.col("kind") == "revisit", F.col("headers")).alias("headers"),
        )
    )
    agree = F.when(F.col("etag").isNotNull(), F.col("etag") == F.col("prior.etag")).when(F.col("modified").isNotNull(), F.col("modified") == F.col("prior.modified"))
    status = F.when(F.col("prior").isNull(), "no_response").when(F.coalesce(agree, F.lit(False)), "resolved").otherwise("validator_mismatch")
    judged = asof.where("kind = 'revisit'").select("record_id", "url_key", "ts", "kind", status.alias("status"), F.col("prior.record_id").alias("prior_id"), "headers")
    none = F.lit(None).cast(dict(records.dtypes)["record_id"])
    odd = meta.where("kind = 'revisit'").where(~sound).select("record_id", "url_key", "ts", "kind", F.lit("no_response").alias("status"), none.alias("prior_id"), "headers")
    revisits = judged.unionByName(odd).withColumn("refers_to", F.when(F.col("status") == "resolved", F.col("prior_id"))).drop("prior_id")
    # the body column last: a response whose id repeats lends its largest body
    lenders = src.where("kind = 'response'").select(F.col("record_id").alias("lender"), F.col("headers").alias("lent"), F.col("body"))
    wanted = revisits.where("refers_to is not null").select(F.col("refers_to").alias("lender")).distinct()
    lent = lenders.join(wanted, "lender").groupBy("lender").agg(F.max_by(F.struct("lent", "body"), F.col("body")).alias("got"))
    updates = F.map_filter(F.col("headers"), lambda k, v: k.isin(*NOT_MODIFIED_HEADERS) & v.isNotNull())
    base = F.map_filter(F.col("got.lent"), lambda k, v: ~F.map_contains_key(updates, k))
    done = revisits.join(lent, F.col("refers_to") == F.col("lender"), "left").select(
        "record_id", "url_key", "ts", "kind", "status", "refers_to",
        F.when(F.col("refers_to").isNotNull(), F.map_concat(base, updates)).otherwise(F.col("headers")).alias("headers"),
        F.col("got.body").alias("body"),
    )
    as_is = src.where("kind is null or kind <> 'revisit'")
    own = F.when(F.col("kind") == "response", "response").otherwise("other")
    return as_is.select("record_id", "url_key", "ts", "kind", own.alias("status"), none.alias("refers_to"), "headers", "body").unionByName(done)


def _latest_response(rows: DataFrame) -> DataFrame:
    """Add ``prior``: the last response of the same URL before (ts, record_id), or null."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = keep(rows.repartitionByRange(n, "url_key", "ts", "record_id").withColumn("slot", F.spark_partition_id()), "captures")
    answer = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "etag", "modified"))
    per_slot = cut.groupBy("url_key", "slot").agg(F.max(answer).alias("last_in_slot"))
    earlier = Window.partitionBy("url_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    handed_on = per_slot.select("url_key", "slot", F.last("last_in_slot", ignorenulls=True).over(earlier).alias("handed_on"))
    inside = Window.partitionBy("url_key", "slot").orderBy("ts", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("near", F.last(answer, ignorenulls=True).over(inside)).join(handed_on, ["url_key", "slot"]).withColumn("prior", F.coalesce("near", "handed_on"))
