"""URL filters as a temporal list join.

List entries are dated: an ``add`` puts a value on a list, a ``remove`` takes it off. They become validity intervals,
each from its add to the value's next event. A capture asks for the values that cover it, all parent domains of its host
and all path prefixes, and an as-of join finds the entries that were active when it was fetched. Allow lists outweigh
block lists. At one instant a remove counts after an add.

A host may hold any share of the captures, so the join is salted: intervals are repeated for each salt, captures take
one. Captures with equal id, url and time are one capture, with their number. A null url asks for nothing and stays
unblocked; a null time meets no entry; entries with nulls in list, kind, value, action or time are void. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 16
URL = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(url, URL, 1), "^.*@", ""), ":[0-9]*$", ""))


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, URL, 2)
    return F.when(path == "", "/").otherwise(path)


def intervals(entries: DataFrame) -> DataFrame:
    """``(list, kind, value, since, until)``: when each entry was active; ``until`` is null for open ones.

    ``entries(list, kind, value, action, at)``: list ``block`` or ``allow``, kind ``domain`` or ``path``, action ``add``
    or ``remove``.
    """
    known = entries.dropna(subset=["list", "kind", "value", "action", "at"]).distinct()
    next_event = F.lead("at").over(Window.partitionBy("list", "kind", "value").orderBy("at", "action"))
    dated = known.withColumn("until", next_event).where("action = 'add' and (until is null or until > at)")
    return dated.select("list", "kind", "value", F.col("at").alias("since"), "until")


def asked(captures: DataFrame) -> DataFrame:
    """A row for each capture and each value that would cover it."""
    labels = F.split("host", r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("value")),
    )
    parts = F.split("path", "/")
    # Prefixes that end at a slash, and the path itself.
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.when(i == F.size(parts), F.concat("host", "path")).otherwise(
            F.concat("host", F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))
        ),
    )
    paths = F.transform(F.array_distinct(prefixes), lambda x: F.struct(F.lit("path").alias("kind"), x.alias("value")))
    located = captures.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))).where("host <> ''")
    return located.select("page_id", "url", "fetched", F.inline(F.concat(domains, paths)))


def evaluated(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``(page_id, url, fetched, captures, n_block, n_allow, blocked, rule)`` for every distinct capture.

    ``rule``: the longest active value that decided, null where no entry was active.
    """
    distinct = captures.groupBy("page_id", "url", "fetched").agg(F.count("*").alias("captures"))
    wanted = asked(captures.select("page_id", "url", "fetched")).distinct()
    wanted = wanted.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "fetched"), F.lit(SALTS)).cast("int"))
    listed = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    active = wanted.join(listed, ["kind", "value", "salt"]).where("since <= fetched and (until is null or fetched < until)")
    found = active.groupBy("page_id", "url", "fetched").agg(
        F.sum(F.when(F.col("list") == "block", 1).otherwise(0)).alias("n_block"),
        F.sum(F.when(F.col("list") == "allow", 1).otherwise(0)).alias("n_allow"),
        F.max(F.struct((F.col("list") == "allow").alias("allow"), F.length("value").alias("size"), "value"))["value"].alias("rule"),
    )
    same = [distinct[x].eqNullSafe(found[x]) for x in ("page_id", "url", "fetched")]
    joined = distinct.join(found, same, "left").select(
        *(distinct[x] for x in ("page_id", "url", "fetched", "captures")),
        *(F.coalesce(found[x], F.lit(0)).alias(x) for x in ("n_block", "n_allow")),
        found["rule"],
    )
    return joined.withColumn("blocked", (F.col("n_block") > 0) & (F.col("n_allow") == 0))
