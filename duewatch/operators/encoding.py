"""Category levels and numeric scaling learned from the training sample, kept as tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

from ..config import INFREQUENT_LEVEL, StudyConfig
from ..functions import fill_missing_levels
from ..session import stage
from .ranking import global_rank


def stack_categories(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """One (feature, level) row per category cell."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("level")) for c in columns]
    return df.select(*keep, F.inline(F.array(*cells)))


def category_levels(
    train: DataFrame, columns: Sequence[str], min_count: int = StudyConfig.min_level_count
) -> DataFrame:
    """Training levels with their counts; rare ones share one encoded level per feature."""
    filled = fill_missing_levels(train, columns)
    counts = stack_categories(filled, columns).groupBy("feature", "level").agg(
        F.count(F.lit(1)).alias("count")
    )
    encoded = F.when(F.col("count") < min_count, F.lit(INFREQUENT_LEVEL)).otherwise(F.col("level"))
    return counts.withColumn("encoded", encoded)


def encoded_feature_count(levels: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Columns the encoder produces: distinct encoded levels plus the numeric features."""
    columns = levels.select("feature", "encoded").distinct().agg(F.count(F.lit(1)).alias("categorical"))
    return columns.select(
        "categorical",
        F.lit(len(numeric)).alias("numeric"),
        (F.col("categorical") + len(numeric)).alias("total"),
    )


def scaler_stats(train: DataFrame, numeric: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation per numeric feature."""
    stats = train.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    F.avg(F.col(c).cast("double")).alias("mean"),
                    F.stddev_pop(F.col(c).cast("double")).alias("std"),
                )
                for c in numeric
            ]
        ).alias("stats")
    )
    return stats.select(F.inline("stats"))


def scaled(column: str, mean: float, std: float) -> Column:
    return (F.col(column).cast("double") - F.lit(mean)) / F.lit(std if std else 1.0)


def join_levels(
    df: DataFrame, lookup: DataFrame, columns: Sequence[str], value: str, suffix: str, *also: str
) -> DataFrame:
    """Left-join ``lookup(feature, level, *also, value)`` once per category column.

    ``lookup`` is partitioned by feature, so each join reads one feature's levels and Spark weighs
    that feature's size when it chooses between broadcast and shuffle.
    """
    for name in columns:
        levels = lookup.where(F.col("feature") == name).select(
            F.col("level").alias(name), *also, F.col(value).alias(f"{name}{suffix}")
        )
        df = df.join(levels, [name, *also], "left")
    return df


@dataclass(frozen=True)
class Encoder:
    """One-hot levels and scaling of one training sample.

    ``levels`` is a table ``(feature, level, encoded, position, place)``: the column of the encoded
    vector that a level sets, and its place within its feature's block. ``sizes`` has the length of
    each block. No level names reach the driver.
    """

    columns: tuple[str, ...]
    levels: DataFrame
    sizes: dict[str, int]
    scaling: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, train: DataFrame, cfg: StudyConfig) -> Encoder:
        counted = stage(category_levels(train, cfg.categorical, cfg.min_level_count), "counted")
        order = F.array_position(F.array(*[F.lit(c) for c in cfg.categorical]), F.col("feature"))
        encoded = counted.select(
            "feature", "encoded", order.alias("_block"), (F.col("encoded") == INFREQUENT_LEVEL).alias("_rare")
        ).distinct()
        ranked = global_rank(encoded, F.asc("_block"), F.asc("_rare"), F.asc("encoded")).select(
            "feature", "encoded", (F.col("rank") - 1).alias("position")
        )
        blocks = {
            r.feature: (r.first, r.size)
            for r in ranked.groupBy("feature").agg(F.min("position").alias("first"), F.count(F.lit(1)).alias("size")).collect()
        }
        first = F.create_map(*[F.lit(x) for f, (at, _) in blocks.items() for x in (f, at)])[F.col("feature")]
        levels = counted.join(ranked, ["feature", "encoded"]).withColumn(
            "place", (F.col("position") - first).cast("double")
        )
        return cls(
            tuple(cfg.categorical),
            stage(levels, "levels", partition_by=("feature",)),
            {c: blocks[c][1] for c in cfg.categorical},
            fit_scaling(train, cfg.numeric),
        )

    @property
    def width(self) -> int:
        """Encoded category columns; the numeric ones follow."""
        return sum(self.sizes.values())

    def names(self, numeric: Sequence[str]) -> DataFrame:
        """``(position, feature)``: the name of every encoded column."""
        spark = self.levels.sparkSession
        named = F.concat(F.lit("cat__"), "feature", F.lit("_"), "encoded")
        categories = self.levels.select("position", named.alias("feature")).distinct()
        numbers = [(self.width + i, f"num__{n}") for i, n in enumerate(numeric)]
        return categories.unionByName(spark.createDataFrame(numbers, "position bigint, feature string"))

    def transform(self, df: DataFrame, scaling: dict[str, tuple[float, float]]) -> DataFrame:
        """Add the sparse ``features`` vector. A level unseen in training leaves its block empty."""
        filled = fill_missing_levels(df, self.columns)
        looked_up = join_levels(filled, self.levels, self.columns, "place", "_place")
        # An unseen level takes the place behind the block's last, which the encoder drops.
        ready = looked_up.withColumns(
            {f"{c}_place": F.coalesce(F.col(f"{c}_place"), F.lit(float(self.sizes[c]))) for c in self.columns}
            | {f"_{n}": scaled(n, *scaling[n]) for n in scaling}
        )
        one_hot = OneHotEncoder(
            inputCols=[f"{c}_place" for c in self.columns], outputCols=[f"{c}_block" for c in self.columns], dropLast=True
        ).fit(self._longest())
        assembler = VectorAssembler(
            inputCols=[*[f"{c}_block" for c in self.columns], *[f"_{n}" for n in scaling]], outputCol="features"
        )
        encoded = assembler.transform(one_hot.transform(ready))
        return encoded.drop(*[f"_{n}" for n in scaling], *[f"{c}_{x}" for c in self.columns for x in ("place", "block")])

    def _longest(self) -> DataFrame:
        """One row with the place behind each block's last, from which the encoder takes the sizes."""
        row = tuple(float(self.sizes[c]) for c in self.columns)
        return self.levels.sparkSession.createDataFrame([row], ", ".join(f"{c}_place double" for c in self.columns))


def fit_scaling(train: DataFrame, numeric: Sequence[str]) -> dict[str, tuple[float, float]]:
    return {r.feature: (r["mean"], r["std"]) for r in scaler_stats(train, numeric).collect()}
