"""Boosted symmetric trees over ordered target statistics of the categories.

*Ordered statistics.* Training rows get a random but fixed order. The rate of a level in a row is taken from the rows
before it alone, so that no row sees its own label. Positions come from :func:`ranking.global_rank`; running sums go band
by band, a band being 65,536 positions, so a level that holds a third of all rows is no single group.

*Symmetric trees.* All nodes of a level share one split, so a tree is a few splits and one value for each pattern of answers.
The split comes from one aggregate per level: sums of gradients and curvatures by (leaf, feature, bin), a table of fixed
size. Gradients are summed as whole numbers, which, for given
borders, makes a fit independent of partitions and of the order of rows. A level is one job over all rows; where they are
one task's (``fit_rows_per_task``), that task grows all trees from the same sums, as thousands of jobs would cost more than
they do. Margins are written anew every few trees; a lost executor reads them again.

Missing levels are a level of their own, unseen levels get the mean rate of the sample, missing numbers go below every border.
Repeated rows count as often as they occur. A sample of one class gives leaves near its log odds; an empty one is an error.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..config import StudyConfig
from ..functions import fill_missing_levels, row_count
from ..session import fit_tasks, stage, staged_path, staging
from .encoding import join_levels, stack_categories
from .forest import NODES, Forest
from .ranking import global_rank

BAND_BITS = 16
UNIT = 1 << 26  # gradients are summed in these parts of one
L2 = 3.0
MOST_BORDERS = 32
TREES_PER_WRITE = 20
ROWS_PER_BLOCK = 1 << 15
ROWS_PER_SCORE = 1 << 11  # bounds the values of all trees held at once
MOST_TABLES = 64  # tasks whose sums the driver adds itself


# --------------------------------------------------------------------------- ordered statistics


def in_drawn_order(train: DataFrame, cfg: StudyConfig) -> DataFrame:
    """``train`` with ``rank``, its position in a random order that only the seed and the rows decide.

    Not the order in which negatives are drawn: the sample holds the first of them there, but positives throughout.
    """
    key = F.md5(F.concat(F.lit(f"order-{cfg.seed}-"), F.coalesce(F.col("complaint_id").cast("string"), F.lit(""))))
    tie = F.xxhash64("target", *cfg.features)
    return global_rank(train.withColumn("_key", key), F.col("_key"), F.col("complaint_id"), tie).drop("_key", "rank_rows")


def ordered_rates(ranked: DataFrame, columns: Sequence[str], prior: float) -> DataFrame:
    """``(rank, feature, rate)``: (positives before + prior) / (rows before + 1) among earlier rows of the same level."""
    band = F.shiftright(F.col("rank") - 1, BAND_BITS).alias("band")
    cells = stack_categories(fill_missing_levels(ranked, columns), columns, "rank", band, "target")
    group = ["feature", "level", "band"]
    totals = cells.groupBy(*group).agg(row_count().alias("n"), F.sum("target").alias("pos"))
    earlier = Window.partitionBy("feature", "level").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *group, *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}_carried") for x in ("n", "pos"))
    )
    within = Window.partitionBy(*group).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("n_carried") + F.coalesce(F.count(F.lit(1)).over(within), F.lit(0))
    pos = F.col("pos_carried") + F.coalesce(F.sum("target").over(within), F.lit(0))
    return cells.join(carried, group).select("rank", "feature", ((pos + prior) / (n + 1)).alias("rate"))


def level_rates(train: DataFrame, columns: Sequence[str], prior: float) -> DataFrame:
    """``(feature, level, rate)`` over the whole sample, for rows that are scored."""
    cells = stack_categories(fill_missing_levels(train, columns), columns, "target")
    rate = (F.sum("target") + prior) / (row_count() + 1)
    return cells.groupBy("feature", "level").agg(rate.alias("rate"))


def training_features(train: DataFrame, cfg: StudyConfig, prior: float) -> DataFrame:
    """``target`` and one double per feature: ordered rates of the categories, numbers as they are."""
    ranked = in_drawn_order(train, cfg)
    rates = ordered_rates(ranked, cfg.categorical, prior).groupBy("rank").agg(
        *(F.max(F.when(F.col("feature") == c, F.col("rate"))).alias(f"{c}_rate") for c in cfg.categorical)
    )
    numbers = [F.col(n).cast("double").alias(f"{n}_num") for n in cfg.numeric]
    return ranked.select("rank", F.col("target").cast("double").alias("target"), *numbers).join(rates, "rank").select(
        "target", *feature_names(cfg)
    )


def feature_names(cfg: StudyConfig) -> list[str]:
    return [f"{c}_rate" for c in cfg.categorical] + [f"{n}_num" for n in cfg.numeric]


# --------------------------------------------------------------------------- growing a tree


@dataclass(frozen=True)
class Tree:
    """Splits ``(feature, border)`` from the root on, their gains, and a value per pattern of answers.

    Bit ``k`` of a pattern is set if the feature of split ``k`` exceeds its border.
    """

    splits: tuple[tuple[str, float], ...]
    gains: tuple[float, ...]
    values: tuple[float, ...]


def quantile_borders(rows: DataFrame, names: Sequence[str], most: int = MOST_BORDERS) -> dict[str, list[float]]:
    """At most ``most`` borders for each feature, near its quantiles; beyond 100,000 rows these are approximate."""
    shares = [k / (most + 1) for k in range(1, most + 1)]
    found = rows.agg(*(F.percentile_approx(name, shares, 100_000).alias(name) for name in names)).first()
    return {name: sorted(set(found[name] or ())) for name in names}


def binned(rows: DataFrame, borders: dict[str, list[float]], start: float) -> DataFrame:
    """``target``, ``margin`` and for each feature the number of borders below its value."""
    bins = []
    for k, (name, at) in enumerate(borders.items()):
        known = ", ".join(f"{float(border)!r}D" for border in at)
        below = F.expr(f"size(filter(array({known}), border -> border < `{name}`))") if at else F.lit(0)
        bins.append(F.when(F.col(name).isNull(), 0).otherwise(below).cast("short").alias(f"bin{k}"))
    return rows.select("target", F.lit(float(start)).alias("margin"), *bins)


@dataclass(frozen=True)
class Block:
    """Some rows of one task: labels, margins, gradients and curvatures in whole units, and ``bins[feature, row]``."""

    target: np.ndarray
    margin: np.ndarray
    slopes: tuple[np.ndarray, np.ndarray]
    bins: np.ndarray

    @classmethod
    def at(cls, target: np.ndarray, margin: np.ndarray, bins: np.ndarray) -> Block:
        chance = 1.0 / (1.0 + np.exp(-margin))
        parts = (chance - target, chance * (1.0 - chance))
        return cls(target, margin, tuple(np.rint(part * UNIT).astype(np.int32) for part in parts), bins)

    def leaf(self, splits: Sequence[tuple[int, int]]) -> np.ndarray:
        leaf = np.zeros(len(self.target), np.int64)
        for level, (feature, border) in enumerate(splits):
            leaf |= (self.bins[feature] > border).astype(np.int64) << level
        return leaf


def block_rows(batches: Iterator[pa.RecordBatch], kind: type) -> Iterator[pa.RecordBatch]:
    """Rows of ``binned`` as pickled blocks."""
    for batch in batches:
        for low in range(0, batch.num_rows, ROWS_PER_BLOCK):
            part = batch.slice(low, ROWS_PER_BLOCK)
            bins = np.stack([part.column(k).to_numpy().astype(kind) for k in range(2, part.num_columns)])
            block = Block.at(part.column(0).to_numpy().astype(np.int8), part.column(1).to_numpy().copy(), bins)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block, 5)], pa.binary())], ["block"])


def blocks(rows: DataFrame, width: int) -> RDD:
    """``binned`` rows as blocks. An RDD, since a fit is thousands of short jobs and planning one would take longer than it."""
    kind = np.uint8 if width <= 256 else np.uint16
    return rows.mapInArrow(partial(block_rows, kind=kind), "block binary").rdd.map(lambda row: pickle.loads(row.block))


def gradient_sums(held: Iterator[Block], splits: Sequence[tuple[int, int]], features: int, width: int) -> Iterator[np.ndarray]:
    """Sums of gradients and curvatures ``[2, feature, leaf and bin]``, in whole units, for one task's rows."""
    cells = width << len(splits)
    sums = np.zeros((2, features, cells), np.int64)
    for block in held:
        parts = [part.astype(np.float64) for part in block.slopes]
        leaf = block.leaf(splits) * width
        for feature in range(features):
            at = leaf + block.bins[feature]
            for k, part in enumerate(parts):
                sums[k, feature] += np.bincount(at, part, cells).astype(np.int64)
    yield sums


def raised(block: Block, splits: Sequence[tuple[int, int]], values: np.ndarray) -> Block:
    """The rows with a tree added to their margins."""
    return Block.at(block.target, block.margin + values[block.leaf(splits)], block.bins)


def histogram(rows: RDD, splits: Sequence[tuple[int, int]], features: int, width: int) -> np.ndarray:
    """Gradients and curvatures ``[2, leaf, feature, bin]`` of all rows: one narrow pass, tables of fixed size from each task."""
    parts = rows.mapPartitions(partial(gradient_sums, splits=list(splits), features=features, width=width))
    return by_leaf(parts.treeReduce(np.add) if rows.getNumPartitions() > MOST_TABLES else parts.reduce(np.add), width)


def by_leaf(sums: np.ndarray, width: int) -> np.ndarray:
    return sums.reshape(*sums.shape[:2], -1, width).swapaxes(1, 2) / UNIT


def boosted(held: Iterator[Block], counts: Sequence[int], cfg: StudyConfig) -> Iterator[tuple]:
    """All trees of a sample whose blocks are one task's: the same sums and steps, without a job for each level."""
    own, width = list(held), max(counts) + 1
    for _ in range(cfg.tree_count):
        tree = grow(lambda splits: by_leaf(next(gradient_sums(own, splits, len(counts), width)), width), counts, cfg)
        own = [raised(block, tree[0], tree[2]) for block in own]
        yield tree


def boosted_by_jobs(rows: RDD, counts: Sequence[int], cfg: StudyConfig) -> Iterator[tuple]:
    """All trees, a job for each level. Rows are kept with their margins, and written every few trees."""
    spark, before = SparkSession.active(), None
    rows.persist()
    for number in range(1, cfg.tree_count + 1):
        tree = grow(lambda splits: histogram(rows, splits, len(counts), max(counts) + 1), counts, cfg)
        if before is not None:
            before.unpersist()
        yield tree
        before, rows = rows, rows.map(partial(raised, splits=tree[0], values=tree[2]))
        if number % TREES_PER_WRITE == 0 and number < cfg.tree_count:
            path = staged_path(spark, "margins")
            rows.saveAsPickleFile(path)
            rows = spark.sparkContext.pickleFile(path, before.getNumPartitions()).coalesce(before.getNumPartitions())
        rows.persist()
    for held in (before, rows):
        if held is not None:
            held.unpersist()


def quality(sums: np.ndarray) -> np.ndarray:
    """What a group of rows gains by a value of its own."""
    return sums[0] ** 2 / (sums[1] + L2)


def gains(sums: np.ndarray) -> np.ndarray:
    """``[feature, border]``: the gain of splitting every leaf there, over not splitting."""
    low = np.cumsum(sums, axis=3)
    whole = low[..., -1:]
    return (quality(low) + quality(whole - low) - quality(whole)).sum(axis=0)


def grow(sums_of: Callable, counts: Sequence[int], cfg: StudyConfig) -> tuple[list, list, np.ndarray]:
    """Splits by feature and border number, their gains, and the leaves' values. Ties go to the first feature and border.

    A tree ends early where no split gains anything.
    """
    width = max(counts) + 1
    allowed = np.arange(width) < np.array(counts)[:, None]
    splits, won = [], []
    while True:
        sums = sums_of(splits)
        leaves = sums[:, :, 0].sum(axis=2)
        by_split = np.where(allowed, gains(sums), -np.inf)
        feature, border = divmod(int(by_split.argmax()), width)
        if not by_split[feature, border] > 1e-9:
            break
        splits.append((feature, border))
        won.append(float(by_split[feature, border]))
        low = sums[:, :, feature, : border + 1].sum(axis=2)
        leaves = np.concatenate([low, sums[:, :, feature].sum(axis=2) - low], axis=1)
        if len(splits) == cfg.tree_depth:
            break
    return splits, won, -cfg.tree_step * leaves[0] / (leaves[1] + L2)


def margins(
    batches: Iterator[pa.RecordBatch], names: Sequence[str], start: float, trees: Sequence[Tree]
) -> Iterator[pa.RecordBatch]:
    """The margin of each row in place of its features, the last columns; trees are added in pairs."""
    for batch in batches:
        kept, sums = batch.num_columns - len(names), []
        for low in range(0, batch.num_rows, ROWS_PER_SCORE):
            part = batch.slice(low, ROWS_PER_SCORE)
            at = {name: part.column(kept + k).to_numpy() for k, name in enumerate(names)}
            terms = [np.full(part.num_rows, float(start))]
            for tree in trees:
                leaf = np.zeros(part.num_rows, np.int64)
                for level, (name, border) in enumerate(tree.splits):
                    leaf |= (at[name] > border).astype(np.int64) << level
                terms.append(np.array(tree.values)[leaf])
            while len(terms) > 1:
                terms = [x + y for x, y in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) & ~1 :]
            sums.append(terms[0])
        margin = pa.array(np.concatenate([np.empty(0), *sums]), pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:kept], margin], [*batch.schema.names[:kept], "_margin"])


# --------------------------------------------------------------------------- model


@dataclass(frozen=True)
class SymmetricTrees:
    """A fitted model: the level rates as a table, the trees (a few dozen numbers each) as they are."""

    columns: tuple[str, ...]
    numeric: tuple[str, ...]
    rates: DataFrame
    prior: float
    start: float
    trees: tuple[Tree, ...]

    def with_features(self, df: DataFrame) -> DataFrame:
        joined = join_levels(fill_missing_levels(df, self.columns), self.rates, self.columns, "rate", "_rate")
        inputs = {f"{c}_rate": F.coalesce(F.col(f"{c}_rate"), F.lit(self.prior)) for c in self.columns}
        return joined.withColumns(inputs | {f"{n}_num": F.col(n).cast("double") for n in self.numeric})

    def score(self, df: DataFrame, *keep: str) -> DataFrame:
        """P(late) as float for every row. Hundreds of lookups as one expression would take longer to plan than to run."""
        names = [f"{c}_rate" for c in self.columns] + [f"{n}_num" for n in self.numeric]
        inputs = (F.coalesce(F.nanvl(name, F.lit(math.inf)), F.lit(-math.inf)).alias(f"_{name}") for name in names)
        ready = self.with_features(df).select(*keep, *inputs)
        kept = ready.schema[: len(ready.columns) - len(names)]
        task = partial(margins, names=names, start=self.start, trees=self.trees)
        found = ready.mapInArrow(task, T.StructType([*kept, T.StructField("_margin", T.DoubleType())]))
        score = 1.0 / (1.0 + F.exp(-F.col("_margin")))
        return found.select(*kept.names, score.cast("float").alias("score"))

    def importance(self) -> DataFrame:
        """Share of the total split gain per feature, in percent; zero for all if nothing was split."""
        won = dict.fromkeys([f"{c}_rate" for c in self.columns] + [f"{n}_num" for n in self.numeric], 0.0)
        for tree in self.trees:
            for (name, _), gain in zip(tree.splits, tree.gains):
                won[name] += gain
        whole = sum(won.values()) or 1.0
        rows = [(name.rsplit("_", 1)[0], 100.0 * gain / whole) for name, gain in won.items()]
        return self.rates.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(
            F.desc("importance"), F.asc("feature")
        )

    def tables(self) -> tuple[DataFrame, DataFrame]:
        """``(tree, level, feature, border, gain)`` and ``(tree, leaf, value)``."""
        spark = self.rates.sparkSession
        splits = [
            (k, level, name, float(border), gain)
            for k, tree in enumerate(self.trees)
            for level, ((name, border), gain) in enumerate(zip(tree.splits, tree.gains))
        ]
        leaves = [(k, leaf, value) for k, tree in enumerate(self.trees) for leaf, value in enumerate(tree.values)]
        return (
            spark.createDataFrame(splits, "tree int, level int, feature string, border double, gain double"),
            spark.createDataFrame(leaves, "tree int, leaf int, value double"),
        )

    def forest(self) -> Forest:
        """The same trees as a table of nodes, numbered level by level."""
        splits, leaves = self.tables()
        level, at = F.col("level"), F.col("at")
        own, below = F.expr("shiftleft(1, level)"), F.expr("shiftleft(2, level)")
        inner = splits.withColumn("at", F.explode(F.sequence(F.lit(0), own - 1))).select(
            "tree", (own - 1 + at).alias("node"), "feature", "border",
            (below - 1 + at).alias("low"), (below - 1 + at + own).alias("high"), F.lit(None).cast("double").alias("value"),
        )
        depth = splits.groupBy("tree").agg(F.max(level + 1).alias("depth"))
        first = F.expr("shiftleft(1, coalesce(depth, 0)) - 1")
        none = [F.lit(None).cast(t).alias(n) for n, t in (("feature", "string"), ("border", "double"), ("low", "int"), ("high", "int"))]
        ends = leaves.join(depth, "tree", "left").select("tree", (first + F.col("leaf")).alias("node"), *none, "value")
        return Forest(inner.unionByName(ends).select(*[c.split()[0] for c in NODES.split(", ")]), self.start)

    def save(self, path: str) -> None:
        self.rates.write.mode("overwrite").partitionBy("feature").parquet(f"{path}/rates")
        for name, table in zip(("splits", "leaves"), self.tables()):
            table.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")
        self.rates.sparkSession.createDataFrame([(self.prior, self.start)], "prior double, start double").write.mode(
            "overwrite"
        ).parquet(f"{path}/numbers")

    @classmethod
    def load(cls, spark: SparkSession, path: str, cfg: StudyConfig) -> SymmetricTrees:
        prior, start = spark.read.parquet(f"{path}/numbers").first()
        splits: dict[int, list] = {}
        for row in spark.read.parquet(f"{path}/splits").orderBy("tree", "level").collect():
            splits.setdefault(row.tree, []).append(row)
        values: dict[int, list] = {}
        for row in spark.read.parquet(f"{path}/leaves").orderBy("tree", "leaf").collect():
            values.setdefault(row.tree, []).append(row.value)
        trees = tuple(
            Tree(
                tuple((s.feature, s.border) for s in splits.get(k, ())),
                tuple(s.gain for s in splits.get(k, ())),
                tuple(values[k]),
            )
            for k in sorted(values)
        )
        return cls(cfg.categorical, cfg.numeric, spark.read.parquet(f"{path}/rates"), prior, start, trees)


def sample_start(train: DataFrame) -> tuple[float, float]:
    """The share of late cases and the log odds that trees start from."""
    rows, late = train.agg(row_count(), F.sum("target")).first()
    if not rows:
        raise ValueError("the training sample is empty")
    return late / rows, math.log((late + 0.5) / (rows - late + 0.5))


def train_symmetric(train: DataFrame, cfg: StudyConfig, borders: dict[str, list[float]] | None = None) -> SymmetricTrees:
    """Fit ``cfg.tree_count`` trees on the log loss; borders of the features may be given."""
    spark = train.sparkSession
    prior, start = sample_start(train)
    rates = stage(level_rates(train, cfg.categorical, prior), "rates", partition_by=("feature",))
    names = feature_names(cfg)
    trees: list[Tree] = []
    with staging(spark, "boosting"):
        features = stage(training_features(train, cfg, prior), "features")
        borders = {name: (borders or quantile_borders(features, names))[name] for name in names}
        at = list(borders.values())
        tasks = fit_tasks(spark, features.count(), cfg.fit_rows_per_task)
        counts = [len(border) for border in at]
        rows = blocks(stage(binned(features, borders, start).repartition(tasks), "margins"), max(counts) + 1)
        if tasks == 1:
            grown = rows.coalesce(1).mapPartitions(partial(boosted, counts=counts, cfg=cfg)).collect()
        else:
            grown = boosted_by_jobs(rows, counts, cfg)
        for splits, won, values in grown:
            trees.append(Tree(tuple((names[f], at[f][b]) for f, b in splits), tuple(won), tuple(map(float, values))))
    return SymmetricTrees(cfg.categorical, cfg.numeric, rates, prior, start, tuple(trees))


def first_gains(train: DataFrame, cfg: StudyConfig, borders: dict[str, list[float]]) -> DataFrame:
    """``(feature, border, gain)``: what each border would gain as the first split of the first tree."""
    prior, start = sample_start(train)
    rows = binned(training_features(train, cfg, prior), {name: borders[name] for name in feature_names(cfg)}, start)
    width = max(map(len, borders.values())) + 1
    won = gains(histogram(blocks(rows, width), [], len(borders), width))
    table = [
        (name, float(border), float(won[k, b]))
        for k, name in enumerate(feature_names(cfg))
        for b, border in enumerate(borders[name])
    ]
    return train.sparkSession.createDataFrame(table, "feature string, border double, gain double")
