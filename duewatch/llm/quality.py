"""Quality rules with host verdicts.

Each text is measured by rules; the failures are summed up by host. A host's failure rate is shrunk towards all hosts'
with a beta prior that is fitted to them by moments, so small hosts are judged mostly by the prior. Documents stay if
they pass the rules themselves and their host's shrunk rate does not exceed ``HOST_LIMIT``.

Null and empty texts have no words and fail. A null host is a host of its own. Repeated rows count as often as they
occur. Extra columns pass through where the whole rows are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged
from .shingles import PLACES, SPACE, mix, text_chunks, word_hashes

MIN_WORDS = 50
#: Most words in repeated three-word windows, in percent of all words.
REPEAT_PERCENT = 50
#: Hosts of which more documents than this share fail, after shrinking, are refused as a whole.
HOST_LIMIT = 0.5
SAME = np.arange(256, dtype=np.uint8)
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def by_text(marks: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many marked bytes each text has."""
    total = np.concatenate([[0], np.cumsum(marks)])
    return np.diff(total[ends], prepend=0)


def repeated_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Words of each text that lie in three-word windows found twice or more in it."""
    out = np.zeros(len(counts), np.int64)
    if len(words) < 3:
        return out
    window = mix(words[:-2] * PLACES[0] + words[1:-1] * PLACES[1] + words[2:] * PLACES[2])
    ends = np.cumsum(counts)
    for row in np.flatnonzero(counts > 3).tolist():
        own = window[ends[row] - counts[row] : ends[row] - 2]
        order = own.argsort()
        same = own[order[1:]] == own[order[:-1]]
        if same.any():
            first = np.zeros(len(own), bool)
            first[order[1:][same]] = True
            first[order[:-1][same]] = True
            inside = np.zeros(len(own) + 2, bool)
            for step in range(3):
                inside[step : step + len(own)] |= first
            out[row] = inside.sum()
    return out


def repeated_lines(data: np.ndarray, ends: np.ndarray) -> list[int]:
    raw, begin, out = data.tobytes(), 0, []
    for end in ends.tolist():
        lines = [line for line in raw[begin:end].split(b"\n") if line.strip(b" \t\r\x0b\x0c")]
        out.append(len(lines) - len(set(lines)))
        begin = end
    return out


def measured(column: pa.Array) -> dict[str, np.ndarray]:
    """The measures of every text."""
    found: dict[str, list] = {name: [np.zeros(0, np.int64)] for name in MEASURES}
    for data, ends, _, _ in text_chunks(column):
        words, counts = word_hashes(data, ends, SAME)
        found["n_words"].append(counts)
        found["word_chars"].append(by_text(~SPACE[data] & ((data & 0xC0) != 0x80), ends))
        found["n_symbols"].append(by_text(SYMBOL[data], ends))
        found["n_dup_lines"].append(np.array(repeated_lines(data, ends), np.int64))
        found["n_repeat_words"].append(repeated_words(words, counts))
    return {name: np.concatenate(parts) for name, parts in found.items()}


def measure_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the measures in the place of the column ``text``."""
    for batch in batches:
        rest = [name for name in batch.schema.names if name != "text"]
        found = measured(batch.column("text"))
        columns = [*(batch.column(name) for name in rest), *(pa.array(found[name], pa.int64()) for name in MEASURES)]
        yield pa.RecordBatch.from_arrays(columns, [*rest, *MEASURES])


def passing_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole rows whose text passes the rules."""
    for batch in batches:
        found = measured(batch.column("text").cast(pa.string()))
        failed = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > REPEAT_PERCENT * found["n_words"])
        yield batch.filter(pa.array(~failed))


def measures(documents: DataFrame, host: str) -> DataFrame:
    """``(doc_id, host, <measures>, base_failed)`` for every row of ``documents(doc_id, text, <host>)``."""
    kinds = {field.name: field.dataType.simpleString() for field in documents.schema}
    rows = documents.select("doc_id", F.col(host).alias("host"), F.col("text").cast("string").alias("text"))
    kept = f"doc_id {kinds['doc_id']}, host {kinds[host]}, " + ", ".join(f"{name} long" for name in MEASURES)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.mapInArrow(measure_rows, kept).withColumn("base_failed", failed)


def host_rates(measured_rows: DataFrame) -> DataFrame:
    """``(host, documents, failures, rate)`` with the shrunk failure rate of each host.

    The prior comes from four sums over all hosts, the only values that reach the driver.
    """
    hosts = measured_rows.groupBy("host").agg(
        F.count("*").alias("documents"), F.sum(F.col("base_failed").cast("long")).alias("failures")
    )
    hosts = staged(hosts, "hosts")
    sums = hosts.agg(
        F.count("*").alias("hosts"),
        F.sum("documents").alias("n"),
        F.sum("failures").alias("f"),
        F.sum(F.col("failures") * F.col("failures") / F.col("documents")).alias("ff"),
    ).first()
    a, b = beta_prior(sums["hosts"], sums["n"] or 0, sums["f"] or 0, sums["ff"] or 0.0)
    return hosts.withColumn("rate", (F.col("failures") + a) / (F.col("documents") + (a + b)))


def beta_prior(hosts: int, n: int, f: int, ff: float) -> tuple[float, float]:
    """Moments of the hosts' rates to a beta distribution; ``ff``: sum of failures squared by documents."""
    if not n:
        return 1.0, 1.0
    mean = f / n
    noise = mean * (1 - mean)
    between = ff / n - mean * mean - noise * hosts / n
    strength = min(max(noise / between - 1, 1.0), 1e6) if between > 0 else 1e6 if noise else 1.0
    return mean * strength, (1 - mean) * strength


def good_host() -> Column:
    return F.col("rate") <= HOST_LIMIT


def judged(documents: DataFrame, host: str) -> DataFrame:
    """The measures of every row with ``kept``."""
    rows = staged(measures(documents, host), "measures")
    hosts = host_rates(rows).select(F.col("host").alias("judged_host"), good_host().alias("good"))
    joined = rows.join(hosts, F.col("host").eqNullSafe(F.col("judged_host")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("good")).drop("judged_host", "good")


def kept_rows(documents: DataFrame, host: str) -> DataFrame:
    """The whole rows that the rules and the host verdicts keep."""
    hosts = host_rates(measures(documents, host))
    refused = hosts.where(~good_host()).select(F.col("host").alias("judged_host"))
    stay = documents.join(refused, documents[host].eqNullSafe(refused["judged_host"]), "left_anti")
    return stay.mapInArrow(passing_rows, documents.schema)
