"""TF-IDF over words and word pairs, and a logistic model on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import CountVectorizerModel, Normalizer
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructField, StructType

from ..config import StudyConfig
from ..functions import with_terms
from ..session import staged_path
from .models import fit_logistic, sigmoid


def term_statistics(docs: DataFrame, text: str = "narrative") -> DataFrame:
    """Per term: total count, number of documents, and smoothed inverse document frequency.

    Each document contributes its terms once for the count and its distinct terms once for the
    document frequency, so only per-task partial sums are shuffled, never (document, term) pairs.
    """
    texts = docs.where(F.col(text).isNotNull())
    terms = with_terms(texts.select(text), text)
    uses = terms.select(
        F.inline(
            F.array(
                F.struct(F.col("terms").alias("found"), F.lit(1).alias("c"), F.lit(0).alias("d")),
                F.struct(F.array_distinct("terms").alias("found"), F.lit(0).alias("c"), F.lit(1).alias("d")),
            )
        )
    )
    counts = (
        uses.select(F.explode("found").alias("term"), "c", "d")
        .groupBy("term")
        .agg(F.sum("c").cast("bigint").alias("count"), F.sum("d").cast("bigint").alias("df"))
    )
    documents = texts.agg(F.count(F.lit(1))).scalar()
    idf = F.ln((1 + documents) / (1 + F.col("df"))) + 1
    return counts.withColumn("idf", idf)


def vocabulary(stats: DataFrame, cfg: StudyConfig) -> DataFrame:
    """The most frequent terms that enough documents share."""
    return (
        stats.where(F.col("df") >= cfg.text_min_df)
        .orderBy(F.desc("count"), F.asc("term"))
        .limit(cfg.text_max_terms)
    )


@dataclass(frozen=True)
class TermIndex:
    """Vocabulary in vector order with idf weights: at most ``text_max_terms`` entries."""

    spark: SparkSession
    terms: tuple[str, ...]
    idf: tuple[float, ...]

    @classmethod
    def fit(cls, docs: DataFrame, cfg: StudyConfig) -> TermIndex:
        rows = vocabulary(term_statistics(docs), cfg).select("term", "idf").collect()
        rows.sort(key=lambda r: r.term)
        return cls(docs.sparkSession, tuple(r.term for r in rows), tuple(r.idf for r in rows))

    def weigh(self, docs: DataFrame, text: str = "narrative") -> DataFrame:
        """Add ``entries``, the (index, weight) pairs of each text, and their L2 ``norm``; all JVM-side.

        Dividing by the norm is left to the caller: inside a lambda it would be redone per entry.
        """
        counted = CountVectorizerModel.from_vocabulary(
            list(self.terms), inputCol="_terms", outputCol="_tf"
        ).transform(with_terms(docs, text, "_terms"))
        idf = self._array(self.idf)
        raw = (
            counted.withColumn("_tf", F.unwrap_udt("_tf"))
            .withColumn("_idf", idf)
            .withColumn(
                "entries",
                F.zip_with(
                    "_tf.indices",
                    "_tf.values",
                    lambda i, tf: F.struct(
                        i.alias("index"), ((1 + F.ln(tf)) * F.get("_idf", i)).alias("weight")
                    ),
                ),
            )
        )
        norm = F.sqrt(F.aggregate("entries", F.lit(0.0), lambda a, e: a + e["weight"] * e["weight"]))
        return raw.withColumn("norm", norm).drop("_terms", "_tf", "_idf")

    def _array(self, values) -> Column:
        return self.spark.createDataFrame([(list(values),)], "v array<double>").scalar()


def tfidf_weights(docs: DataFrame, cfg: StudyConfig) -> DataFrame:
    """TF-IDF in long form: one row per document and vocabulary term."""
    index = TermIndex.fit(docs, cfg)
    terms = index.spark.createDataFrame([(list(index.terms),)], "v array<string>").scalar()
    # The outer form adds no filter on the array, which would tokenise every text once more.
    entries = index.weigh(docs).select("complaint_id", "norm", F.inline_outer("entries"))
    return entries.where(F.col("index").isNotNull()).withColumn("_terms", terms).select(
        "complaint_id",
        F.get("_terms", F.col("index")).alias("term"),
        (F.col("weight") / F.col("norm")).alias("weight"),
    )


@dataclass(frozen=True)
class TextModel:
    """Term coefficients and intercept of a logistic model on TF-IDF."""

    index: TermIndex
    coefficients: tuple[float, ...]
    intercept: float

    def score(self, docs: DataFrame, *keep: str, text: str = "narrative") -> DataFrame:
        """P(late) as double for every text."""
        weighed = self.index.weigh(docs, text).withColumn("_coef", self.index._array(self.coefficients))
        dot = F.aggregate(
            "entries", F.lit(0.0), lambda a, e: a + e["weight"] * F.get("_coef", e["index"])
        )
        # A text without vocabulary terms has norm 0 and scores the intercept alone.
        margin = F.coalesce(F.try_divide(dot, F.col("norm")), F.lit(0.0)) + F.lit(self.intercept)
        return weighed.select(*keep, sigmoid(margin).alias("score"))

    def term_coefficients(self) -> DataFrame:
        """Terms by coefficient, most late-leaning first."""
        return self.index.spark.createDataFrame(
            list(zip(self.index.terms, self.coefficients)), "term string, coefficient double"
        ).orderBy(F.desc("coefficient"), F.asc("term"))

    def save(self, path: str) -> None:
        spark = self.index.spark
        rows = list(zip(self.index.terms, self.index.idf, self.coefficients))
        spark.createDataFrame(rows, "term string, idf double, coefficient double").write.mode(
            "overwrite"
        ).parquet(f"{path}/terms")
        spark.createDataFrame([(self.intercept,)], "intercept double").write.mode("overwrite").parquet(
            f"{path}/numbers"
        )

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextModel:
        rows = sorted(spark.read.parquet(f"{path}/terms").collect(), key=lambda r: r.term)
        index = TermIndex(spark, tuple(r.term for r in rows), tuple(r.idf for r in rows))
        intercept = spark.read.parquet(f"{path}/numbers").first().intercept
        return cls(index, tuple(r.coefficient for r in rows), intercept)


def train_text(sample: DataFrame, cfg: StudyConfig) -> TextModel | None:
    """Fit on the sampled rows that have text; None when there are too few of them."""
    docs = sample.where(F.col("narrative").isNotNull()).select("target", "narrative")
    rows = docs.count()
    if rows < cfg.text_min_train_rows:
        return None
    index = TermIndex.fit(docs, cfg)
    raw = _vectors(index.weigh(docs).select("target", "entries"), len(index.terms))
    entries = raw.agg(F.sum(F.size(F.unwrap_udt("raw")["indices"]))).first()[0]
    vectors = Normalizer(inputCol="raw", outputCol="features").transform(raw)
    # A text has hundreds of entries, so tasks are cut by them.
    fitted = fit_logistic(vectors, rows, cfg, max(1, rows * cfg.fit_entries_per_task // max(1, entries)))
    return TextModel(index, tuple(float(v) for v in fitted.coefficients.toArray()), float(fitted.intercept))


def _vectors(weighed: DataFrame, size: int) -> DataFrame:
    """``(target, entries)`` as ``(target, raw)``: written as a sparse vector's fields and read back as one, all JVM-side."""
    fields = F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(size).alias("size"),
        F.col("entries.index").alias("indices"),
        F.col("entries.weight").alias("values"),
    )
    path = staged_path(weighed.sparkSession, "text-vectors")
    weighed.select("target", fields.alias("raw")).write.parquet(path)
    schema = StructType([weighed.schema["target"], StructField("raw", VectorUDT())])
    return weighed.sparkSession.read.schema(schema).parquet(path)


def top_terms(coefficients: DataFrame, rows: int = 15) -> DataFrame:
    """The leading and the trailing terms of a coefficient table."""
    late = coefficients.orderBy(F.desc("coefficient"), F.asc("term")).limit(rows)
    timely = coefficients.orderBy(F.asc("coefficient"), F.desc("term")).limit(rows)
    return late.withColumn("side", F.lit("untimely")).unionByName(
        timely.withColumn("side", F.lit("timely"))
    )
