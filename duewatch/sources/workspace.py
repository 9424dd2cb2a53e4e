"""The tables one study leaves behind for its later steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from .files import write_table


@dataclass(frozen=True)
class Workspace:
    """Parquet stores under one root folder; wide ones are partitioned by year."""

    spark: SparkSession
    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    # population and narratives ------------------------------------------------
    def write_population(self, structured: DataFrame) -> None:
        self._write_by_year(structured, "population")

    def population(self, *years: int) -> DataFrame:
        return self._years(self._read("population"), years)

    def write_narratives(self, texts: DataFrame) -> None:
        self._write_by_year(texts, "narratives")

    def narratives(self, *years: int) -> DataFrame:
        """Texts of the given years only; a year without a store has no rows."""
        return self._years(self._read("narratives"), years)

    # training sample and scores -----------------------------------------------
    def write_sample(self, sample: DataFrame) -> None:
        sample.write.mode("overwrite").parquet(self.path("train_sample"))

    def sample(self) -> DataFrame:
        return self._read("train_sample")

    def write_scores(self, scores: DataFrame, model: str, year: int) -> None:
        """Scores keyed by complaint, label beside them so that metrics need no join; one folder per
        model and year, replaced as a whole."""
        (
            scores.select("complaint_id", "target", F.col("score").cast("float").alias("score"))
            .write.mode("overwrite")
            .parquet(self.path(f"scores/model={model}/year={year}"))
        )

    def scores(self, model: str, year: int) -> DataFrame | None:
        """Scores of one model and year, or None when that run never happened."""
        found = self._try_read(f"scores/model={model}/year={year}")
        return found and found.withColumns({"model": F.lit(model), "year": F.lit(year)})

    # result tables --------------------------------------------------------------
    def write_result(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(self.path(f"results/{name}"))
        write_table(self._read(f"results/{name}"), self.path(f"tables/{name}"))

    def result(self, name: str) -> DataFrame | None:
        return self._try_read(f"results/{name}")

    def publish(self, df: DataFrame, name: str) -> None:
        write_table(df, self.path(f"dashboard/{name}"))

    # helpers ----------------------------------------------------------------------
    def _write_by_year(self, df: DataFrame, name: str) -> None:
        # Rows stay in the tasks that read them: a year may hold half of all rows.
        df.write.mode("overwrite").partitionBy("year").parquet(self.path(name))

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def _try_read(self, name: str) -> DataFrame | None:
        try:
            return self._read(name)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    @staticmethod
    def _years(df: DataFrame, years: tuple[int, ...]) -> DataFrame:
        return df.where(F.col("year").isin(*years)) if years else df
