"""Registered queries of the numbered operators, each over its whole table, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat import digests
from .common import table
from .context_mixing import scores
from .decontamination import found_leaks
from .html_text import extracted
from .jaccard_join import jaccard_components
from .packing import packed
from .periodic_runs import periodic_runs
from .quality import judged
from .sharding import sharded
from .spelling import variants
from .toxicity import toxicity_scores
from .url_filters import evaluated, host_of
from .warc import Archive

#: A document counts as toxic from this score.
TOXIC_FROM = 0.7


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("predicted", (F.col("score") >= TOXIC_FROM).cast("int"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -1, whose texts consist of control strings."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    return digests(rows.unionByName(spark.createDataFrame(hostile, rows.schema)))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drawn(value: Column, most: int) -> Column:
    """A number below ``most`` that depends on a string alone."""
    return F.conv(F.substring(F.md5(value), 1, 6), 16, 10).cast("int") % most


def day(number: Column) -> Column:
    return F.to_timestamp_ntz(F.date_add(F.lit("2024-01-01").cast("date"), number))


def dated_entries(pages: DataFrame) -> DataFrame:
    """A history of list entries for the hosts of the pages, drawn from their names."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    draw = drawn(F.col("host"), 1 << 24)
    path = F.concat("host", F.lit("/en/"))
    events = [
        (draw % 3 == 0, "block", "domain", F.col("host"), "add", draw % 200),
        (draw % 3 == 0, "block", "domain", F.col("host"), "remove", draw % 200 + 30 + draw % 50),
        (draw % 6 == 0, "block", "domain", F.col("host"), "add", draw % 200 + 120),
        (draw % 4 == 1, "block", "path", path, "add", draw % 300),
        (draw % 5 == 0, "allow", "domain", F.col("host"), "add", draw % 100 + 60),
        (draw % 5 == 0, "allow", "domain", F.col("host"), "remove", draw % 100 + 150),
    ]
    made = F.array(
        *(
            F.when(
                holds,
                F.struct(
                    F.lit(listed).alias("list"), F.lit(kind).alias("kind"), value.alias("value"),
                    F.lit(action).alias("action"), day(at).alias("at"),
                ),
            )
            for holds, listed, kind, value, action, at in events
        )
    )
    return hosts.select(F.explode(made).alias("event")).where("event is not null").select("event.*")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as captures, each fetched on a day of 2024 that its url decides."""
    pages = table(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", day(drawn(F.col("url"), 366)).alias("fetched"))
    return evaluated(captures, dated_entries(pages))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The host of a document is its source."""
    return judged(table(spark, sf_dir, "documents"), "source").drop("host")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = Archive.write(pages).read(pages)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), rewrite=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_packing": op2_packing,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_decontamination": op4_decontamination,
    "op5_url_filters": op5_url_filters,
    "op6_quality_rules": op6_quality_rules,
    "op7_sharding": op7_sharding,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_html_extraction": op9_html_extraction,
    "op10_warc": op10_warc,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_context_mixing": op12_context_mixing,
    "op13_periodic_runs": op13_periodic_runs,
}
