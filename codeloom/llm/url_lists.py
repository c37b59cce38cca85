"""URL filters that change over time.  Built-in expressions only.

A list has dated entries: from a day on, a pattern is blocked, allowed, or no
longer listed.  Entries become validity intervals, and a capture is judged by
the intervals that hold on the day it was fetched.  The as-of join is an equality
join on pattern and month with a range test inside the month, so a pattern with
a long history costs a capture at most a month of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK, ALLOW, END = "block", "allow", "end"
#: Columns that ``judge`` adds.
ADDED = ("pattern", "rule", "valid_from", "valid_to")


def host(url: Column) -> Column:
    """The host in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def segments(url: Column) -> Column:
    """The non-empty parts of the path."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    return F.array_remove(F.split(path, "/"), "")


def patterns(url: Column) -> Column:
    """All patterns that can match a URL: its host, the domains above it of two
    labels or more, and the host with each leading part of the path."""
    name = host(url)
    labels = F.split(name, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    parts = segments(url)
    paths = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i > 0),
        lambda i: F.concat(name, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")),
    )
    return F.when(name != "", F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """``pattern, rule, valid_from, valid_to``: when each entry holds.

    ``entries``: ``entry_id, pattern, rule, day``.  An entry holds from its day
    until the day of the next one for the pattern (``valid_to`` excluded; null:
    still holds).  Of several on a day the largest ``entry_id`` counts, then the
    rule last in the alphabet.  Entries without pattern, rule or day count for
    nothing.
    """
    dated = entries.where("pattern IS NOT NULL AND rule IS NOT NULL AND day IS NOT NULL")
    daily = dated.groupBy("pattern", "day").agg(F.max(F.struct("entry_id", "rule")).alias("last"))
    # One row for each day that has entries for the pattern.
    following = F.lead("day").over(Window.partitionBy("pattern").orderBy("day"))
    held = daily.select("pattern", F.col("last.rule").alias("rule"), F.col("day").alias("valid_from"), following.alias("valid_to"))
    return held.where(F.col("rule") != END)


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``captures`` with ``pattern, rule, valid_from, valid_to``: the entry that decides.

    ``captures`` has ``url`` and ``fetched`` (a date).  Of the entries that hold,
    the longest pattern decides; all are null if there is none, or no host, or no
    date.  Equal (url, fetched) are judged once.  Other columns of ``captures`` are
    kept, whatever their names; those named like one of the four give way to it.
    """
    seen = captures.select(F.col("url").alias("_url"), F.col("fetched").alias("_fetched")).distinct()
    seen = seen.where(F.col("_url").isNotNull() & F.col("_fetched").isNotNull())
    keyed = seen.select(
        "_url", "_fetched", F.trunc("_fetched", "month").alias("month"), F.explode(patterns(F.col("_url"))).alias("pattern")
    )
    held = intervals(entries)
    # Open intervals reach to the last capture.
    last = captures.agg(F.max("fetched").alias("until"))
    until = last.first()["until"]
    until = F.lit(until).cast("date")
    ends = F.least(F.coalesce(F.date_sub("valid_to", 1), until), until)
    months = F.sequence(F.trunc("valid_from", "month"), F.trunc(ends, "month"), F.expr("interval 1 month"))
    by_month = held.where(F.col("valid_from") <= ends).withColumn("month", F.explode(months))
    found = keyed.join(by_month, ["pattern", "month"]).where(
        (F.col("valid_from") <= F.col("_fetched"))
        & (F.col("valid_to").isNull() | (F.col("_fetched") < F.col("valid_to")))
    )
    best = found.groupBy("_url", "_fetched").agg(
        F.max_by(F.struct("pattern", "rule", "valid_from", "valid_to"), F.length("pattern")).alias("entry")
    )
    rows = captures.select(F.struct("*").alias("row"), "url", "fetched")
    joined = rows.join(best, (F.col("url") == F.col("_url")) & (F.col("fetched") == F.col("_fetched")), "left")
    kept = [F.col("row").getField(name).alias(name) for name in captures.columns if name.lower() not in ADDED]
    return joined.select(*kept, *[F.col("entry").getField(name).alias(name) for name in ADDED])
