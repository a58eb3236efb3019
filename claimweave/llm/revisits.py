"""WARC revisit records of the not-modified kind, resolved to the response they stand for.

Each revisit meets the latest earlier full response of its canonical URL by an as-of join over
range partitions, so one URL may span many tasks. Its validators are checked against that
response's, and the stored headers are updated with those a 304 may carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimweave.llm.common import pinned

# The headers of RFC 9110, section 15.4.5, that a 304 response sends to update a stored one.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")

RESPONSE, REVISIT = "response", "revisit"


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case and without ``www.``, no default port, no fragment, no tracking
    parameters, no empty query and no trailing slash; http and https are one. Null stays null."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r":(80|443)$", ""), r"^www\.", "")
    path = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    path = F.regexp_replace(path, r"(?<=[?&])utm_[a-z]+=[^&]*(&|$)", "")
    path = F.regexp_replace(F.regexp_replace(path, r"[?&]+$", ""), r"/$", "")
    return F.when(host != "", F.concat(host, path))


def _latest_earlier(records: DataFrame) -> DataFrame:
    """``records`` (``url``, ``at``, ``rank``, ``id``, ``key``, ``full``) with ``met``: the last non-null ``full`` before, within the URL."""
    order = ["url", "at", "rank", "id", "key"]
    ranges = pinned(records.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "revisit-ranges")
    before = Window.partitionBy("part", "url").orderBy(*order[1:]).rowsBetween(Window.unboundedPreceding, -1)
    # What crosses a border is the last full response of a partition: one row per partition.
    last = ranges.where("full is not null").groupBy("part").agg(F.max_by(F.struct("url", "full"), F.struct(*order)).alias("last"))
    parts = ranges.select("part").distinct().join(last, "part", "left")
    carried = parts.select("part", F.last("last", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    inside = F.last("full", ignorenulls=True).over(before)
    joined = ranges.withColumn("inside", inside).join(F.broadcast(carried), "part")
    return joined.withColumn("met", F.coalesce("inside", F.when(F.col("carried.url") == F.col("url"), F.col("carried.full")))).drop("part", "inside", "carried")


def _record_key(headers: Column) -> Column:
    """Two hashes of all that a record says. Records of one key are equal, so it does not matter whose body is taken."""
    parts = [F.col("url"), F.col("at"), F.col("record_id"), F.col("body")]
    told = [x for part in parts for x in (part.isNull(), part)] + [F.array_sort(F.map_entries(headers))]
    return F.struct(F.xxhash64(F.lit(0), *told).alias("a"), F.xxhash64(F.lit(1), *told).alias("b"))


def resolve(records: DataFrame) -> DataFrame:
    """Every revisit with the response it stands for.

    ``records`` has ``record_id``, ``url``, ``at`` (a time or a number), ``kind`` (``response`` or
    ``revisit``), ``status``, ``headers`` (a map with lower-case names) and ``body``. A response is
    full if its status is 200 and it has a body.

    The result has a row per revisit: ``record_id``, ``canonical_url``, ``at``, ``outcome``, ``source_id``,
    and, if resolved, ``headers`` (stored ones, updated by the permitted ones of the revisit) and
    ``body``. Outcomes: ``resolved``; ``no_url``; ``no_response`` (none is strictly earlier);
    ``changed`` (the revisit's etag, or without one its last-modified time, differs from the
    response's); ``no_validator`` (neither is on both sides). ``source_id`` is null for the first two.

    Weak etags compare by their value. Of responses at one time the largest id is the latest, null
    ids being the smallest, and of equal ids the one with the largest hash of the record. Ids need
    not be unique or present: bodies are fetched by that hash, so each revisit gets the body of the
    very record it met, once, and a response without id resolves with a null ``source_id``. Null
    headers are no headers. Revisits that repeat give as many rows. A null time is earlier than any
    other. Texts may be of any length. Other columns are ignored; an empty table gives no rows.
    """
    headers = F.coalesce(F.col("headers"), F.create_map().cast("map<string,string>"))
    key = _record_key(headers)
    full = (F.col("kind") == RESPONSE) & (F.col("status") == 200) & F.col("body").isNotNull()
    # Bodies stay behind; they are fetched once the responses are known.
    light = records.select(
        canonical_url(F.col("url")).alias("url"),
        F.col("at"),
        F.when(F.col("kind") == REVISIT, 0).otherwise(1).alias("rank"),  # at the same time nothing is earlier
        F.col("record_id").alias("id"),
        key.alias("key"),
        headers.alias("headers"),
        F.when(full, F.struct(F.col("record_id").alias("id"), key.alias("key"), headers.alias("headers"))).alias("full"),
    ).where((F.col("rank") == 0) | F.col("full").isNotNull())
    light = light.withColumn("headers", F.when(F.col("rank") == 0, F.col("headers")))
    known = _latest_earlier(light.where("url is not null")).where("rank = 0")
    lost = light.where("url is null and rank = 0").withColumn("met", F.lit(None).cast(known.schema["met"].dataType))
    revisits = known.unionByName(lost)

    mine, theirs = F.col("headers"), F.col("met.headers")
    plain = lambda tag: F.regexp_replace(tag, "^W/", "")
    etags = mine["etag"].isNotNull() & theirs["etag"].isNotNull()
    dates = mine["last-modified"].isNotNull() & theirs["last-modified"].isNotNull()
    outcome = (
        F.when(F.col("url").isNull(), "no_url")
        .when(F.col("met").isNull(), "no_response")
        .when(etags, F.when(plain(mine["etag"]) == plain(theirs["etag"]), "resolved").otherwise("changed"))
        .when(dates, F.when(mine["last-modified"] == theirs["last-modified"], "resolved").otherwise("changed"))
        .otherwise("no_validator")
    )
    updates = F.map_filter(mine, lambda name, _: name.isin(*PERMITTED))
    stored = F.map_filter(theirs, lambda name, _: ~F.array_contains(F.map_keys(updates), name))
    found = revisits.select(
        F.col("id").alias("record_id"), F.col("url").alias("canonical_url"), "at", outcome.alias("outcome"), F.col("met.id").alias("source_id"), F.map_concat(stored, updates).alias("headers"), F.col("met.key").alias("key")
    ).withColumn("headers", F.when(F.col("outcome") == "resolved", F.col("headers")))
    found = pinned(found, "revisit-found")
    # Equal records have one key and one body.
    bodies = records.where(full).select(key.alias("key"), "body").groupBy("key").agg(F.first("body").alias("body"))
    # Many revisits of one response are one hot key: adaptive execution splits it, since this side is a plain scan.
    resolved = found.where("outcome = 'resolved'").join(bodies, "key", "left")
    rest = found.where("outcome <> 'resolved'").withColumn("body", F.lit(None).cast(records.schema["body"].dataType))
    return resolved.unionByName(rest).drop("key")
