"""Global positions, score ladders, quantiles and the binning rules built on them.

Three primitives carry everything:

* :func:`global_rank` gives every row its position in a total order through a range-partitioned
  sort. The order ends in the id, so rows with equal scores are split over tasks as well.
* :func:`score_ladder` reduces rows to one per distinct score (map-side, so a score shared by a
  third of all rows costs one row per task) and adds running totals.
* :func:`at_positions` reads values at given positions off a ladder: exact quantiles.

There are several binning rules and they differ on purpose; see each function.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from ..functions import passes, row_count, safe_ratio, uniform_bin
from ..session import stage

POSITION_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def global_rank(df: DataFrame, *order: Column) -> DataFrame:
    """Add ``rank``, the 1-based position of every row under ``order``, and ``rank_rows``, their
    number, without a single-task window.

    Rows are range-partitioned and sorted, written once with their (partition, row) numbers, and
    shifted by the sizes of the earlier partitions. The size table has one row per partition.
    """
    numbered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id())
        .withColumn("_part", F.shiftright("_at", POSITION_BITS))
        .withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << POSITION_BITS) - 1)))
        .drop("_at")
    )
    written = stage(numbered, "ranked")
    sizes = written.groupBy("_part").agg(row_count().alias("_n"))
    earlier = F.sum("_n").over(
        Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = sizes.select(
        "_part",
        F.coalesce(earlier, F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("rank_rows"),
    )
    return (
        written.join(F.broadcast(offsets), "_part")  # bounded by the number of partitions
        .withColumn("rank", F.col("_before") + F.col("_row") + 1)
        .drop("_part", "_row", "_before")
    )


# Bands per power of two, coarse first. A float has 2**23 values per power of two, so one of the 128
# bands holds under 2**17 distinct floats whatever the data. Doubles get a second, finer level.
COARSE, FINE = 128, 1 << 20


def known_score(score: Column) -> Column:
    """The score itself; a missing one (null or NaN) has no place in an order and fails the query."""
    missing = score.isNull() | F.isnan(score.cast("double"))
    return F.when(missing, F.raise_error(F.lit("a score is missing"))).otherwise(score)


def _band(score: Column, per_octave: int = COARSE) -> Column:
    """An order-preserving bucket of a score: finer near zero, computed without looking at the data.

    Between 0 and 1 there are under 20,000 coarse bands for floats. Never null, so joins on it add
    no filter that would tell one use of a table from another.
    """
    offset = 1100 * per_octave  # below the smallest positive double
    size = F.floor(F.log2(F.abs(score.cast("double"))) * per_octave) + offset
    band = F.when(score == 0, F.lit(0)).when(score > 0, size).otherwise(-size).cast("bigint")
    return F.coalesce(band, F.lit(0).cast("bigint"))


def score_ladder(
    scored: DataFrame, by: Sequence[str] = (), score: str = "score", target: str = "target"
) -> DataFrame:
    """One row per distinct score with counts, counts of all higher scores, and totals.

    Columns: ``*by, score, n, pos, n_above, pos_above, n_total, pos_total``.

    Running totals go level by level: bands are few, so their running totals are cheap; inside a
    band the window holds only that band's distinct scores.
    """
    is_float = scored.schema[score].dataType == FloatType()
    resolutions = (COARSE,) if is_float else (COARSE, FINE)
    bands = [f"_band{i}" for i in range(len(resolutions))]
    steps = (
        scored.groupBy(*by, known_score(F.col(score)).alias("score"))
        .agg(row_count().alias("n"), F.sum(target).cast("bigint").alias("pos"))
        .withColumns({b: _band(F.col("score"), r) for b, r in zip(bands, resolutions)})
    )

    def sums(table: DataFrame, keys: list[str]) -> DataFrame:
        return table.groupBy(*by, *keys).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))

    levels = [sums(steps, bands)]
    for depth in range(len(bands) - 1, 0, -1):
        levels.insert(0, sums(levels[0], bands[:depth]))

    whole = Window.partitionBy(*[F.col(c) for c in by] or [F.lit(0)])
    above = levels[0].select(
        *by,
        bands[0],
        *_sums_above([*by], bands[0]),
        F.sum("n").over(whole).alias("n_total"),
        F.sum("pos").over(whole).alias("pos_total"),
    )
    for depth, level in enumerate(levels[1:], start=1):
        own = level.select(*by, *bands[: depth + 1], *_sums_above([*by, *bands[:depth]], bands[depth]))
        above = _shifted(own, above, [*by, *bands[:depth]])
    own = steps.select(
        *by, *bands, "score", "n", "pos", *_sums_above([*by, *bands], "score")
    )
    return _shifted(own, above, [*by, *bands]).drop(*bands)


def _sums_above(group: list[str], order: str) -> list[Column]:
    """Counts of the rows that come earlier in falling order within the group."""
    keys = [F.col(c) for c in group] or [F.lit(0)]
    earlier = (
        Window.partitionBy(*keys).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    )
    return [
        F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_above") for c in ("n", "pos")
    ]


def _shifted(own: DataFrame, outer: DataFrame, keys: list[str]) -> DataFrame:
    """Add the counts above the enclosing band to the counts above within it."""
    base = outer.withColumnsRenamed({"n_above": "_n_base", "pos_above": "_pos_base"})
    return (
        own.join(base, keys)
        .withColumns(
            {
                "n_above": F.col("n_above") + F.col("_n_base"),
                "pos_above": F.col("pos_above") + F.col("_pos_base"),
            }
        )
        .drop("_n_base", "_pos_base")
    )


def quantile_edges(ladder: DataFrame, parts: int, inner: bool = False) -> DataFrame:
    """One row: the ``parts``-quantile edges of the score, linearly interpolated, as ``edges``.

    ``inner`` leaves out the minimum and the maximum.
    """
    span = range(1, parts) if inner else range(parts + 1)
    scaled = [(i, F.lit(i) * (F.col("n_total") - 1)) for i in span]
    lowers = [F.floor(s / parts) for _, s in scaled]
    uppers = [F.least(low + 1, F.col("n_total") - 1) for low in lowers]
    fraction = [F.pmod(s, F.lit(parts)) / parts for _, s in scaled]
    picked = ladder.agg(
        *[at_position(p).alias(f"low{i}") for i, p in enumerate(lowers)],
        *[at_position(p).alias(f"high{i}") for i, p in enumerate(uppers)],
        *[F.max(f).alias(f"part{i}") for i, f in enumerate(fraction)],
    )
    edges = [
        F.col(f"low{i}") + (F.col(f"high{i}") - F.col(f"low{i}")) * F.col(f"part{i}")
        for i in range(len(scaled))
    ]
    return picked.select(F.array(*edges).alias("edges"))


def at_position(position: Column) -> Column:
    """Aggregate over a ladder: the score at a 0-based position in rising order."""
    below = F.col("n_total") - F.col("n_above") - F.col("n")
    inside = (below <= position) & (position < below + F.col("n"))
    return F.max(F.when(inside, F.col("score").cast("double")))


def edges_below(edges: Sequence[float] | None, column: Column) -> Column:
    """How many of a handful of edges are below the value."""
    value = column.cast("double")
    return sum(((value > F.lit(e)).cast("int") for e in edges if e is not None), F.lit(0))


# --------------------------------------------------------------------------- binning rules


def _lift_decile(position: Column, rows: Column) -> Column:
    """Falling order, equal tenths, remainder in decile 10."""
    tenth = F.greatest(F.floor(rows / 10), F.lit(1))
    return (F.least(F.floor((position - 1) / tenth), F.lit(9)) + 1).cast("int")


def decile_lift(scored: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """Records, late cases, rate, lift and cumulative share per decile; 1 is the highest scores."""
    runs = ranked_runs(scored, [_lift_decile], falling=True, score=score, target=target)
    deciles = (
        runs.groupBy(_lift_decile(F.col("rank"), F.col("rank_rows")).alias("decile"))
        .agg(F.sum("n").alias("records"), F.sum("pos").alias("untimely"))
    )
    return with_lift(deciles)


def with_lift(deciles: DataFrame) -> DataFrame:
    """Rates, lift and cumulative share of ``(decile, records, untimely)``, ten rows."""
    whole = Window.partitionBy(F.lit(0))
    upto = whole.orderBy("decile").rowsBetween(Window.unboundedPreceding, 0)
    base = safe_ratio(F.sum("untimely").over(whole), F.sum("records").over(whole))
    rate = safe_ratio(F.col("untimely"), F.col("records"))
    return deciles.select(
        "decile",
        "records",
        "untimely",
        rate.alias("rate"),
        F.try_divide(rate, base).alias("lift"),
        safe_ratio(100 * F.sum("untimely").over(upto), F.sum("untimely").over(whole)).alias(
            "cumulative_untimely_pct"
        ),
    )


def cumulative_gains(lift: DataFrame) -> DataFrame:
    """Points of the gains curve from a :func:`decile_lift` table."""
    return lift.select(
        (F.col("decile") * 10).alias("reviewed_pct"),
        F.col("cumulative_untimely_pct").alias("captured_pct"),
    )


def add_decile(df: DataFrame, score: str = "pred_proba") -> DataFrame:
    """Ascending quantile bin of the raw value: 1 is the lowest scores.

    Edges are interpolated deciles, repeated edges are merged, bins are right-closed. A single
    distinct value puts every row in decile 1. If some scores are missing, the others are binned by
    rank instead and the missing ones get no decile.
    """
    known = F.col(score).isNotNull()
    ladder = score_ladder(df.where(known).withColumn("_none", F.lit(0)), score=score, target="_none")
    edges = quantile_edges(ladder, 10).select(F.array_distinct("edges")).first()[0]
    if edges[0] == edges[-1]:
        return df.withColumn("decile", F.lit(1))
    if df.where(~known).isEmpty():
        return df.withColumn("decile", F.greatest(edges_below(edges, F.col(score)), F.lit(1)))
    order = [F.asc(score), *[F.asc(c) for c in df.columns if c != score]]
    ranked = global_rank(df.where(known), *order).withColumn("decile", risk_group_of(10) + 1)
    return ranked.select(*df.columns, "decile").unionByName(
        df.where(~known).withColumn("decile", F.lit(None).cast("int"))
    )


def decile_summary(df: DataFrame) -> DataFrame:
    """Rows per decile, and labelled rows with their mean label when labels are present."""
    measures = [row_count().alias("records")]
    if "actually_untimely" in df.columns:
        measures += [
            F.count("actually_untimely").alias("count"),
            F.avg("actually_untimely").alias("mean"),
        ]
    return df.where(F.col("decile").isNotNull()).groupBy("decile").agg(*measures).orderBy("decile")


def ranked_runs(
    scored: DataFrame,
    rules: Sequence[Callable[[Column, Column], Column]],
    falling: bool = False,
    score: str = "score",
    target: str = "target",
) -> DataFrame:
    """Runs of neighbouring rows ``(score, n, pos, rank, rank_rows)`` that no rule tells apart.

    A rule maps (position, rows) to a group and never falls along the order. Rows of one score are
    one run, read off the ladder, so nothing is sorted in full. Only the scores that hold a border
    between groups, at most one per group and rule, are ranked row by row, ties broken by id.
    """
    rows = scored.select("complaint_id", F.col(score).alias("score"), F.col(target).alias("target"))
    ladder = score_ladder(rows)
    before = F.col("n_above") if falling else F.col("n_total") - F.col("n_above") - F.col("n")
    first, last, total = F.col("rank"), F.col("rank") + F.col("n") - 1, F.col("rank_rows")
    split = reduce(lambda a, b: a | b, [rule(first, total) != rule(last, total) for rule in rules])
    runs = ladder.select("score", "n", "pos", (before + 1).alias("rank"), F.col("n_total").alias("rank_rows"))
    runs = stage(runs.withColumn("_split", split), "runs")
    whole = runs.where(~F.col("_split")).drop("_split")
    borders = runs.where("_split").orderBy("rank").collect()
    if not borders:
        return whole
    order = F.desc("score") if falling else F.asc("score")
    own = rows.where(F.col("score").isin([b["score"] for b in borders]))
    shift, passed = F.lit(None).cast("bigint"), 0
    for b in borders:
        shift = F.when(F.col("score") == F.lit(b["score"]), F.lit(b["rank"] - 1 - passed)).otherwise(shift)
        passed += b["n"]
    single = global_rank(own, order, F.asc("complaint_id")).select(
        "score",
        F.lit(1).cast("bigint").alias("n"),
        F.col("target").cast("bigint").alias("pos"),
        (F.col("rank") + shift).alias("rank"),
        F.lit(borders[0]["rank_rows"]).cast("bigint").alias("rank_rows"),
    )
    return whole.unionByName(single)


def risk_group_of(groups: int, rank: Column | None = None, rows: Column | None = None) -> Column:
    """Equal-sized group (0-based, ascending) of a ranked row: quantile bins of the rank itself."""
    rank = F.col("rank") if rank is None else rank
    rows = F.col("rank_rows") if rows is None else rows
    scaled = (rank - 1) * groups
    span = F.greatest(rows - 1, F.lit(1))
    ceiling = F.floor((scaled + span - 1) / span)
    return F.greatest(ceiling - 1, F.lit(0)).cast("int")


def ascending_rank(scored: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    rows = scored.select("complaint_id", F.col(score).alias("score"), F.col(target).alias("target"))
    return global_rank(rows, F.asc("score"), F.asc("complaint_id"))


def risk_groups(scored: DataFrame, groups: int = 10, score: str = "score") -> DataFrame:
    """Every row with its equal-sized risk group; ties are broken by id, so none collapses."""
    return ascending_rank(scored, score).withColumn("risk_group", risk_group_of(groups))


def triage_rank(scored: DataFrame, score: str = "score") -> DataFrame:
    """Every row with its falling rank, the rank's share of all rows, and the decile of that share."""
    return _triage_columns(global_rank(scored, F.desc(score), F.asc("complaint_id")))


def _triage_columns(ranked: DataFrame) -> DataFrame:
    share = F.round(safe_ratio(F.col("rank"), F.col("rank_rows")), 6)
    decile = F.least(F.floor(F.col("percentile") * 10) + 1, F.lit(10)).cast("int")
    return ranked.withColumn("percentile", share).withColumn("decile", decile).drop("rank_rows")


# Columns a work queue shows, where the input has them.
QUEUE_COLUMNS = (
    "complaint_id", "company", "product", "sub_product", "issue", "state", "channel",
    "year", "month", "quarter",
)


def triage_queue(
    scored: DataFrame, rows: int, threshold: float, score: str = "score", target: str = "target"
) -> DataFrame:
    """The ``rows`` best-ranked cases with rank, percentile, decile and flag.

    Only the head of the ranking is needed, so nothing is sorted in full: band counts give a score
    that at least ``rows`` cases reach, and the top-k runs over the cases at or above it.
    """
    narrow = scored.select(
        "complaint_id",
        known_score(F.col(score)).alias("score"),
        passes(scored, score, threshold).cast("int").alias(f"flagged_at_{round(threshold * 100):03d}"),
        F.col(target).alias("actually_untimely"),
    ).withColumn("_band", _band(F.col("score")))
    counts = narrow.groupBy("_band").agg(row_count().alias("n"))
    higher = Window.partitionBy(F.lit(0)).orderBy(F.desc("_band")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    lowest = (
        counts.withColumn("above", F.coalesce(F.sum("n").over(higher), F.lit(0)))
        .where(F.col("above") < rows)
        .agg(F.min("_band"))
        .scalar()
    )
    order = (F.desc("score"), F.asc("complaint_id"))
    best = narrow.where(F.col("_band") >= lowest).orderBy(*order).limit(rows)
    # At most ``rows`` rows, the size of the report.
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))
    ranked = best.withColumn("rank", position.cast("bigint"))
    return _triage_columns(ranked.withColumn("rank_rows", counts.agg(F.sum("n")).scalar())).drop("_band")


def queue_details(queue: DataFrame, cases: DataFrame) -> DataFrame:
    """A queue with the case columns that ``cases`` has."""
    shown = [c for c in QUEUE_COLUMNS if c in cases.columns]
    rest = [c for c in queue.columns if c not in shown]
    return cases.select(*shown).join(queue, "complaint_id").select(*shown, *rest)


def queue_summary(queue: DataFrame) -> DataFrame:
    """Size of a queue, the late cases in it and their share."""
    return queue.agg(
        row_count().alias("queue_rows"),
        F.coalesce(F.sum("actually_untimely"), F.lit(0)).cast("bigint").alias("untimely"),
        F.avg("actually_untimely").alias("untimely_share"),
    )


def uniform_bins(scored: DataFrame, bins: int = 10, score: str = "score") -> DataFrame:
    """Left-closed bins of equal width on [0, 1]; empty bins are absent."""
    return (
        scored.groupBy(uniform_bin(F.col(score), bins).alias("bin"))
        .agg(
            row_count().alias("n"),
            F.avg(F.col(score).cast("double")).alias("mean_score"),
            F.avg("target").alias("observed_rate"),
        )
    )


def score_histogram(scored: DataFrame, bins: int = 50, score: str = "score") -> DataFrame:
    """Density of the score per class on [0, 1], empty bins included."""
    inside = scored.where(F.col(score).between(0, 1))
    counts = inside.groupBy("target", uniform_bin(F.col(score), bins).alias("bin")).agg(row_count().alias("n"))
    # From here on at most two classes times ``bins`` rows.
    filled = (
        counts.groupBy("target")
        .agg(
            F.sum("n").alias("total"),
            F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"),
        )
        .select("target", "total", "by_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    )
    n = F.coalesce(F.try_element_at("by_bin", F.col("bin")), F.lit(0))
    return filled.select(
        "target",
        "bin",
        (F.col("bin") * (1.0 / bins)).alias("left_edge"),
        n.cast("bigint").alias("n"),
        (n / (F.col("total") * (1.0 / bins))).alias("density"),
    )
