"""URL filters by dated lists: every capture is judged by the entries that held when it was fetched.

List entries add or remove a rule on a day. Per rule they become validity intervals that don't overlap. A capture has a key for each
rule that could hit it, and meets the interval that holds its day, at most one per rule. Both sides are dealt by rule and month, so
the captures of a very common host spread over time and no rule's history meets captures of other months.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from barloom.llm.columns import fresh, let


def host_of(url: Column) -> Column:
    """The host in lower case, without port; empty if there is none."""
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def rule_keys(url: Column) -> Column:
    """All rules that could hit a URL: ``domain:`` of each suffix of its host, ``prefix:`` of the host with each leading part of the path."""
    def up(labels: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))

    def down(host: Column, steps: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(F.lit("prefix:"), host, F.array_join(F.slice(steps, 1, i), "/")))

    keys = let(host_of(url), lambda h: F.concat(let(F.split(h, r"\."), up), let(F.split(path_of(url), "/"), lambda s: down(h, s))))
    return F.when(host_of(url) != "", keys).otherwise(F.array().cast("array<string>"))


def _month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def validity(entries: DataFrame) -> DataFrame:
    """(list, rule, since, until) from (list, rule, action, day): from an addition to the next removal, which is excluded; ``until``
    is null while the rule holds. Repeated additions change nothing; of a day's entries a removal counts; rows with a null are void."""
    known = entries.filter(F.col("rule").isNotNull() & F.col("day").isNotNull() & F.col("action").isin("add", "remove"))
    daily = known.groupBy("list", "rule", "day").agg(F.max(F.col("action") == "remove").alias("gone"))
    order = W.partitionBy("list", "rule").orderBy("day")
    turns = daily.withColumn("was", F.lag("gone").over(order)).filter(F.coalesce(F.col("gone") != F.col("was"), ~F.col("gone")))
    return turns.withColumn("until", F.lead("day").over(order)).filter(~F.col("gone")).select("list", "rule", F.col("day").alias("since"), "until")


def listed(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched", into: str = "listed") -> DataFrame:
    """``captures`` with ``into``: the sorted (list, rule) pairs that held for them on their day; empty where none did.

    A capture with a null or hostless URL or without a day meets no rule. Repeated rows are judged alike; a column already called
    ``into`` is replaced.
    """
    captures = captures.drop(into)
    sites = captures.select(F.col(url).alias("u"), F.col(day).alias("d")).filter("u is not null and d is not null").distinct()
    keys = sites.select("u", "d", F.explode(F.array_distinct(rule_keys(F.col("u")))).alias("rule"), _month(F.col("d")).alias("month"))
    first, last = (F.lit(x).cast("date") for x in captures.agg(F.min(day), F.max(day)).first())
    spans = validity(entries).filter((F.col("since") <= last) & (F.coalesce("until", F.date_add(last, 1)) > first))
    months = F.sequence(_month(F.greatest("since", first)), _month(F.least(F.coalesce(F.date_sub("until", 1), last), last)))
    held = spans.select("list", "rule", "since", "until", F.explode(months).alias("month"))
    met = keys.join(held, ["rule", "month"]).filter((F.col("since") <= F.col("d")) & F.coalesce(F.col("until") > F.col("d"), F.lit(True)))
    verdicts = met.groupBy("u", "d").agg(F.sort_array(F.collect_set(F.struct("list", "rule"))).alias("l"))
    u, d, found = fresh(captures, ["_u", "_d", "_l"])
    verdicts = verdicts.withColumnsRenamed({"u": u, "d": d, "l": found})
    rows = captures.join(verdicts, (F.col(url) == F.col(u)) & (F.col(day) == F.col(d)), "left")
    none = F.array().cast("array<struct<list:string,rule:string>>")
    return rows.select(*captures.columns, F.coalesce(found, none).alias(into))


def allowed(captures: DataFrame, entries: DataFrame, url: str = "url", day: str = "fetched") -> DataFrame:
    """The captures that no rule hit when they were fetched."""
    (hits,) = fresh(captures, ["_hits"])
    return listed(captures, entries, url, day, hits).filter(F.size(hits) == 0).drop(hits)
