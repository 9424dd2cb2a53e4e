"""Reading the raw export and writing result tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import RAW_TO_SHORT, StudyConfig
from ..functions import as_missing
from .records import quoted_csv


def read_complaints(spark: SparkSession, path, columns: dict[str, str] = RAW_TO_SHORT) -> DataFrame:
    """The wanted columns of quoted CSV files as strings, under their short names.

    Quoted line breaks do not stop a file from being split: see :mod:`.records`.
    """
    raw = quoted_csv(spark, path)
    return raw.select(
        *[as_missing(F.col(f"`{name}`")).alias(short)
          for name, short in columns.items() if name in raw.columns]
    )


def split_text(population: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Structure without text, and ``(complaint_id, year, narrative)`` where text exists."""
    structured = population.drop("narrative", "timely_response")
    texts = population.where(F.col("has_narrative")).select("complaint_id", "year", "narrative")
    return structured, texts


def source_row_count(df: DataFrame, chunk_rows: int = StudyConfig.read_chunk_rows) -> DataFrame:
    """Rows in a source and how many fixed-size chunks they would fill."""
    rows = F.count(F.lit(1))
    return df.agg(
        rows.alias("source_rows"),
        F.ceil(rows / F.lit(chunk_rows)).cast("bigint").alias("chunks"),
    )


def _number(name: str) -> Column:
    """A numeric CSV cell; missing markers, NaN among them, are null."""
    value = as_missing(F.col(name)).try_cast("double")
    return F.when(~F.isnan(value), value)


def read_scored_file(spark: SparkSession, path: str, alternate: str | None = None) -> DataFrame:
    """A scored CSV with a ``pred_proba`` column, from ``path`` or else from ``alternate``."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    for candidate in filter(None, (path, alternate)):
        try:
            scored = reader.csv(candidate)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if "pred_proba" not in scored.columns:
            raise ValueError(f"missing required column pred_proba; found {scored.columns[:20]}")
        typed = scored.withColumn("pred_proba", _number("pred_proba"))
        if "actually_untimely" in scored.columns:
            typed = typed.withColumn("actually_untimely", _number("actually_untimely").cast("int"))
        return typed
    raise FileNotFoundError(f"no scored file at {path} or {alternate}")


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Publish a result table."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        # Padding is data: a blank is a value, not a missing one.
        writer = (
            writer.option("header", True)
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
    writer.format(fmt).save(path)
