"""URL filters: list entries with dates become validity intervals; each capture meets those active when it was fetched.

All of it is DataFrame operations. Days are integers (days since 1970-01-01).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gaugeworks.llm.common import fresh

BUCKET = 90  # days; an interval is looked up by key and bucket, so a key with a long history isn't scanned whole


def intervals(entries: DataFrame) -> DataFrame:
    """``list, key, since, until`` (until exclusive, null while active) from ``list, key, day, action`` ('add' or 'remove').

    Entries of one list, key and day count once and a removal wins over an addition. Adding what is active or removing
    what isn't changes nothing. Rows with a null list, key or day, or another action, are dropped. A key has at most one
    row a day here, so its history is bounded by the calendar however often it is listed.
    """
    known = entries.where("list is not null and key is not null and day is not null and action in ('add', 'remove')")
    net = known.groupBy("list", "key", "day").agg((F.min("action") == F.max("action")).alias("same"), F.max("action").alias("action"))
    state = net.select("list", "key", "day", (F.col("same") & (F.col("action") == "add")).alias("on"))
    w = W.partitionBy("list", "key").orderBy("day")
    turns = state.withColumn("was", F.lag("on", 1, False).over(w)).where("on <> was")
    return turns.withColumn("until", F.lead("day").over(w)).where("on").select("list", "key", F.col("day").alias("since"), "until")


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def keys_of(url: Column) -> Column:
    """What an entry can name: ``d:`` the host and each domain above it of two labels or more, ``p:`` host and first path
    segment, ``u:`` host and path. A URL without a host has no keys."""
    host = host_of(url)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    labels = F.split(host, r"\.")
    many = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(many - 1, F.lit(1))), lambda i: F.concat(F.lit("d:"), F.array_join(F.slice(labels, i, many), ".")))
    segment = F.regexp_extract(path, r"^/([^/]+)", 1)
    paths = F.array(F.concat(F.lit("p:"), host, F.lit("/"), segment), F.concat(F.lit("u:"), host, path))
    return F.when(host != "", F.concat(domains, F.when(segment != "", paths).otherwise(F.array().cast("array<string>"))))


def active(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """All rows and columns of ``captures`` (``url``, ``day``) with ``lists``: names of the lists with an active entry, sorted
    (``lists_`` and so on if there is such a column).

    Equal (url, day) are judged once before they meet the entries, so a capture repeated very often costs one lookup.
    Null URLs or days, and an empty list table, give no lists.
    """
    spans = intervals(entries)
    last = captures.agg(F.max("day").alias("last"))
    ends = F.least(F.coalesce(F.col("until") - 1, F.col("last")), F.col("last"))
    spans = spans.crossJoin(F.broadcast(last)).where(F.col("since") <= F.col("last"))  # one row: the last day of all
    spans = spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("since") / BUCKET), F.floor(ends / BUCKET)))).drop("last")
    once = captures.select("url", "day").where("url is not null and day is not null").distinct()
    asked = once.withColumn("key", F.explode(keys_of(F.col("url")))).withColumn("bucket", F.floor(F.col("day") / BUCKET))
    hit = asked.join(spans, ["key", "bucket"]).where((F.col("since") <= F.col("day")) & (F.col("until").isNull() | (F.col("day") < F.col("until"))))
    lists = hit.groupBy("url", "day").agg(F.array_sort(F.collect_set("list")).alias("lists"))
    (name,) = fresh(captures.columns, "lists")
    out = captures.join(lists.withColumnRenamed("lists", name), ["url", "day"], "left")
    return out.select(*(f"`{c}`" for c in captures.columns), F.coalesce(name, F.array().cast("array<string>")).alias(name))


def judge(captures: DataFrame, entries: DataFrame, allow: str = "allow") -> DataFrame:
    """``active`` with ``blocked``: some list is active and ``allow`` isn't. Its name, too, gets more underscores where ``captures`` has it."""
    out = active(captures, entries)
    name, blocked = out.columns[-1], *fresh(out.columns, "blocked")
    return out.withColumn(blocked, (F.size(name) > 0) & ~F.array_contains(name, allow))
