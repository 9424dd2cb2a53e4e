"""Sums of decision trees as a table of nodes, compiled into column expressions.

A node table has a row ``(tree, node, feature, border, low, high, value)`` for every node; node 0 of a tree is its root. An
inner node sends a row to ``high`` if its feature exceeds the border, else to ``low``, missing features included. A leaf
has no feature and adds its value. Scoring is then arithmetic inside generated code: no vectors, no joins, no Python.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NODES = "tree int, node int, feature string, border double, low int, high int, value double"


@dataclass(frozen=True)
class Forest:
    """Trees that add up to a margin. The table of nodes has the model's size, whatever is scored."""

    nodes: DataFrame
    start: float = 0.0

    def margin(self) -> Column:
        """The sum of all trees for a row with the features as columns."""
        trees: dict[int, dict[int, tuple]] = {}
        for row in self.nodes.select("tree", "node", "feature", "border", "low", "high", "value").collect():
            trees.setdefault(row.tree, {})[row.node] = row
        return total([walk(trees[tree], 0) for tree in sorted(trees)], self.start)

    def score(self, df: DataFrame, *keep: str, scale: float = 1.0) -> DataFrame:
        """The logistic of ``scale`` times the margin, as float, for every row."""
        score = 1.0 / (1.0 + F.exp(F.lit(-scale) * self.margin()))
        return df.select(*keep, score.cast("float").alias("score"))

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        start = self.nodes.sparkSession.createDataFrame([(self.start,)], "start double")
        start.write.mode("overwrite").parquet(f"{path}/start")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Forest:
        start = spark.read.parquet(f"{path}/start").first().start
        return cls(spark.read.schema(NODES).parquet(f"{path}/nodes"), start)

    @classmethod
    def of_stored_trees(cls, spark: SparkSession, path: str, features: Sequence[str]) -> Forest:
        """The node table of an ensemble that MLlib stored below ``path``; its splits must be numeric."""
        # By place: the store's column names differ between versions of Spark.
        weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weights")
        data = spark.read.parquet(f"{path}/data").toDF("treeID", "nodeData")
        data = data.join(weights.drop("metadata"), "treeID")
        node = F.col("nodeData")
        inner = node["leftChild"] >= 0
        names = F.array(*[F.lit(name) for name in features])
        return cls(
            data.select(
                F.col("treeID").cast("int").alias("tree"),
                node["id"].cast("int").alias("node"),
                F.when(inner, F.try_element_at(names, node["split"]["featureIndex"] + 1)).alias("feature"),
                F.when(inner, node["split"]["leftCategoriesOrThreshold"][0]).alias("border"),
                F.when(inner, node["leftChild"]).cast("int").alias("low"),
                F.when(inner, node["rightChild"]).cast("int").alias("high"),
                F.when(~inner, node["prediction"] * F.col("weights")).alias("value"),
            )
        )


def walk(nodes: dict[int, tuple], at: int) -> Column:
    """The value of the leaf that a row reaches from a node."""
    row = nodes[at]
    if row.feature is None:
        return F.lit(row.value)
    above = F.col(row.feature).cast("double") > F.lit(row.border)
    return F.when(above, walk(nodes, row.high)).otherwise(walk(nodes, row.low))


def total(terms: list[Column], start: float) -> Column:
    """The sum of the terms, added in pairs so that the expression stays shallow."""
    terms = [F.lit(float(start)), *terms]
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) & ~1 :]
    return terms[0]
