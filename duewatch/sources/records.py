"""Records of quoted text files that hold line breaks inside quotes, read in parallel.

A line break ends a record if the number of quotes before it is even. That number is a running sum over the whole file, so
it is taken in two steps: every split of the file counts its own quotes, and a prefix sum over one row per split
tells each split whether it begins inside a record. Then every task joins the lines of its records, and
the few records that cross a border between splits are put together from their pieces.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

QUOTE = '"'
MARKS = "file long, block long, quotes long, ends_even boolean, ends_odd boolean"
FOUND = "file long, owner long, block long, first boolean, record string"
Split = tuple[int, int]


def lines_of(spark: SparkSession, path) -> DataFrame:
    """``(file, block, value)``: lines in the order of their split; a split is named by its file and first byte."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Split, pa.Array, np.ndarray]]:
    """Runs of lines of one split, with the number of quotes in each line."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = (batch.column(name).to_numpy() for name in ("file", "block"))
        lines = batch.column("value")
        quotes = pc.count_substring(lines, QUOTE).to_numpy().astype(np.int64)
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)], strict=True):
            yield (int(file[low]), int(block[low])), lines[low:high], quotes[low:high]


def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per split: its quotes, and whether a line ends behind an even, an odd number of them."""
    found: dict[Split, list] = {}
    for split, _, quotes in by_split(batches):
        state = found.setdefault(split, [0, False, False])
        ends = (state[0] + np.cumsum(quotes)) % 2
        state[0] += int(quotes.sum())
        state[1] |= bool((ends == 0).any())
        state[2] |= bool((ends == 1).any())
    rows = [(*split, *state) for split, state in found.items()]
    columns = zip(*rows, strict=True) if rows else [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
    names = [part.split()[0] for part in MARKS.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names)


def carried(rows: list) -> tuple[dict[Split, int], set[Split]]:
    """Splits that begin inside a record, with the split where it began; and the splits where such a record begins.

    ``rows``: one for each split, as :func:`marks` gives them. Only the splits named here differ from the others.
    """
    inside: dict[Split, int] = {}
    begun: set[Split] = set()
    file, odd, owner = None, False, 0
    for at, block, quotes, ends_even, ends_odd in sorted(tuple(row) for row in rows):
        if at != file:
            file, odd = at, False
        if odd:
            inside[at, block] = owner
        if not odd or ends_odd:  # a record ends here, or none was open: what is open behind it began here
            owner = block
        odd ^= quotes % 2 == 1
        if odd:
            begun.add((at, owner))
    return inside, begun


def joined(inside: dict[Split, int], pieces: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines to whole records within a split, or to the pieces of records that cross its borders.

    ``first`` marks the first record of a file. A piece has the ``owner``, the split where its record began.
    """
    names = [part.split()[0] for part in FOUND.split(", ")]

    def rows(split: Split, owner: int | None, first: bool, records: pa.Array) -> pa.RecordBatch:
        n = len(records)
        firsts = np.zeros(n, bool)
        firsts[:1] = first
        columns = [pa.array([value] * n, pa.int64()) for value in (split[0], owner, split[1])]
        return pa.RecordBatch.from_arrays([*columns, pa.array(firsts), records.cast(pa.string())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, odd, owner, first, open_ = None, 0, None, False, []

        def left() -> Iterator[pa.RecordBatch]:
            if open_ and pieces:
                begun = split[1] if owner is None else owner
                yield rows(split, begun, first, pa.array(["\n".join(open_)]))

        for now, lines, quotes in by_split(batches):
            if now != split:
                yield from left()
                split, open_, owner = now, [], inside.get(now)
                odd, first = int(owner is not None), now[1] == 0
            total = odd + np.cumsum(quotes)
            odd = int(total[-1]) % 2
            ends = np.flatnonzero(total % 2 == 0)
            if not len(ends):
                open_ += lines.to_pylist()
                continue
            head = "\n".join([*open_, *lines[: ends[0] + 1].to_pylist()])
            open_ = lines[ends[-1] + 1 :].to_pylist()
            if owner is not None:
                if pieces:
                    yield rows(split, owner, False, pa.array([head]))
            elif not pieces:
                yield rows(split, None, first, pa.array([head]))
            owner, first = None, False
            if not pieces and len(ends) > 1:
                inner = lines[ends[0] + 1 : ends[-1] + 1]
                cuts = pa.array(np.concatenate([[0], ends[1:] - ends[0]]), pa.int32())
                yield rows(split, None, False, pc.binary_join(pa.ListArray.from_arrays(cuts, inner), "\n"))
        yield from left()

    return run


def quoted_records(spark: SparkSession, path) -> DataFrame:
    """``(first, record)`` for every record below ``path``; ``first`` marks the first one of a file.

    Every task reads its own splits, twice, and a third time if records cross borders. One row per split passes the
    driver. A quote inside an unquoted field counts as a quote, as RFC 4180 has it; a quote that is never closed makes the
    rest of its file one record. Blank lines between records are no records; a line may end with a carriage return.
    """
    lines = lines_of(spark, path)
    inside, begun = carried(lines.mapInArrow(marks, MARKS).collect())
    found = lines.mapInArrow(joined(inside, False), FOUND).select("first", "record")
    if begun:
        parts = lines.mapInArrow(joined(inside, True), FOUND)
        in_order = F.sort_array(F.collect_list(F.struct("block", "record")))
        whole = parts.groupBy("file", "owner").agg(
            F.bool_or("first").alias("first"), F.array_join(F.transform(in_order, lambda x: x["record"]), "\n").alias("record")
        )
        found = found.unionByName(whole.select("first", "record"))
    return found.withColumn("record", F.regexp_replace("record", "\r$", "")).where("first or record <> ''")


def quoted_csv(spark: SparkSession, path) -> DataFrame:
    """The rows of quoted CSV files with a header as strings, equal to reading them with ``multiLine``."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", QUOTE).option("escape", QUOTE)
    names = reader.csv(path).schema  # reads the first record only
    options = {"quote": QUOTE, "escape": QUOTE, "multiLine": "true"}
    schema = ", ".join(f"`{name.replace('`', '``')}` string" for name in names.fieldNames())
    rows = quoted_records(spark, path).where("not first")
    return rows.select(F.from_csv("record", schema, options).alias("row")).select("row.*")
