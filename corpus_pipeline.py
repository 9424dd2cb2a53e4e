"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread by the next.

Quality rules and toxicity drop the documents they reject, the Jaccard join keeps one document of each group,
decontamination drops documents into which a benchmark item leaked, and packing places the ids of the rest.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duewatch.llm.common import table, work_folder
from duewatch.llm.decontamination import without_leaks
from duewatch.llm.jaccard_join import row_components, row_key
from duewatch.llm.packing import packed
from duewatch.llm.quality import kept_rows
from duewatch.llm.queries import TOXIC_FROM
from duewatch.llm.toxicity import below_score

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs, "source")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return below_score(docs, table(spark, sf_dir, "labels"), TOXIC_FROM)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays, by the smallest (id, hash of the text); rows without an id stay.

    Unlike texts under one id are in different components, so they stay. Texts without words are in none: one stays
    of each id. Of rows equal in id and text, the one stays whose other columns have the smallest hash.
    """
    rows = row_components(docs.where("doc_id is not null"))
    own = F.when(F.col("n") == 0, F.col("doc_id"))
    chosen = rows.groupBy("component", own.alias("own")).agg(F.min(F.struct("doc_id", "key"))["key"].alias("chosen_key"))
    rest = F.struct(*(x for x in docs.columns if x != "text"))
    keyed = docs.where("doc_id is not null").select(
        F.struct(*docs.columns).alias("whole"), row_key().alias("chosen_key"), F.xxhash64(F.to_json(rest)).alias("rest")
    )
    first = keyed.join(chosen, "chosen_key", "left_semi").groupBy("chosen_key").agg(F.min_by("whole", "rest").alias("whole"))
    return first.select("whole.*").unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("toxicity", toxicity),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Neither the trained network nor the tokenizer can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = work_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
