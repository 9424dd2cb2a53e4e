"""Class-balanced training sample of an exact size, reproducible from the ids alone."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import StudyConfig
from .ranking import global_rank

PREFIX = 4  # hex digits that a round of refinement adds: at most 65,536 prefixes whatever the number of rows


def draw_key(cfg: StudyConfig, key: str = "complaint_id") -> Column:
    """A fixed pseudo-random hex key per complaint; the smallest keys are drawn. Rows without an id share one."""
    return F.md5(F.concat(F.lit(f"{cfg.seed}-"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def undersample_negatives(pool: DataFrame, cfg: StudyConfig) -> DataFrame:
    """All positives and exactly ``min(ratio * positives, negatives)`` negatives.

    The draw is a cut in the key space, located by radix selection: rows are counted by a prefix of the key, and the one
    prefix that holds the cut is refined by more digits until the cut lies between two prefixes or within one key. Two
    rounds are enough unless billions of keys compete. The sample itself is a plain filter: no sort, no join.
    """
    keyed = pool.withColumn("_draw", draw_key(cfg))
    negative = F.coalesce(F.col("target"), F.lit(0)) == 0
    totals = pool.agg(
        F.count_if(~negative).alias("positives"), F.count_if(negative).alias("negatives")
    ).first()
    wanted = totals.positives * cfg.negatives_per_positive
    if totals.negatives < wanted:
        warnings.warn(f"wanted {wanted} negatives, only {totals.negatives} available; using all")
        return pool
    if totals.negatives == wanted:
        return pool
    if wanted == 0:
        return pool.where(~negative)

    prefix, surplus, copies = _cut(keyed.where(negative).select("_draw"), wanted)
    border = F.substring("_draw", 1, len(prefix))
    if surplus == 0:
        return keyed.where(~negative | (border <= prefix)).drop("_draw")
    # Copies of one id straddle the cut: keep as many of them as still fit.
    some = global_rank(
        keyed.where(negative & (border == prefix)), *[F.col(c) for c in pool.columns]
    ).where(F.col("rank") <= copies - surplus)
    whole = keyed.where(~negative | (border < prefix))
    return whole.unionByName(some.drop("rank", "rank_rows")).drop("_draw")


def _cut(keys: DataFrame, wanted: int) -> tuple[str, int, int]:
    """The prefix of ``_draw`` at which the ``wanted`` smallest keys end: (prefix, rows up to it less wanted, rows in it).

    Rows are left over only if the prefix is a whole key. Each round's window runs over the prefixes of one refinement.
    """
    prefix, before = "", 0
    while True:
        digits = len(prefix) + PREFIX
        sizes = (
            keys.where(F.substring("_draw", 1, len(prefix)) == prefix)
            .groupBy(F.substring("_draw", 1, digits).alias("prefix"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("_draw").alias("low"), F.max("_draw").alias("high"))
        )
        running = F.sum("n").over(
            Window.partitionBy(F.lit(0)).orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        )
        upto = sizes.withColumn("upto", running + before).where(F.col("upto") >= wanted)
        at = upto.agg(F.min(F.struct("prefix", "upto", "n", "low", "high")).alias("at")).first()["at"]
        if at.upto == wanted or at.low == at.high:
            return at.low if at.low == at.high else at.prefix, at.upto - wanted, at.n
        prefix, before = at.prefix, at.upto - at.n
