"""Quoted CSV read in splits equals the same file read whole."""

import random

import pytest
from pyspark.sql import functions as F

from duewatch.sources.records import carried, quoted_csv, quoted_records


def cell(rng):
    kind = rng.random()
    text = "".join(rng.choice('ab,é \n"x') if kind < 0.5 else rng.choice("abc ") for _ in range(rng.randrange(0, 25)))
    if kind < 0.06:
        text = "long\n\n" * rng.randrange(1, 120)
    if rng.random() < 0.1:
        text = text.replace("\n", "\r\n")
    return '"' + text.replace('"', '""') + '"' if set(text) & set(',"\n\r') or kind < 0.1 else text


def written(rng, path, rows, end="\n"):
    lines = ["id,a b,c"] + [f"{i},{cell(rng)},{cell(rng)}" for i in range(rows)]
    path.write_bytes((end.join(lines) + (end if rng.random() < 0.5 else "")).encode())


def whole(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


@pytest.fixture
def splits(spark):
    """Sets the size of a split."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")

    def set_to(size):
        for name, value in zip(names, (size, 1), strict=True):
            spark.conf.set(name, str(value))

    yield set_to
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("size", [400, 5000, 1 << 27])
def test_equal_to_reading_whole(spark, tmp_path, splits, size):
    rng = random.Random(size)
    written(rng, tmp_path / "one.csv", 90)
    written(rng, tmp_path / "two.csv", 30)
    path = str(tmp_path)
    expected = sorted(map(tuple, whole(spark, path).collect()), key=repr)
    splits(size)
    got = quoted_csv(spark, path)
    assert got.columns == ["id", "a b", "c"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected and len(expected) == 120
    if size == 400:
        assert len(quoted_records(spark, path).select(F.spark_partition_id()).distinct().collect()) > 5


def test_carriage_returns_blank_lines_and_a_record_over_many_splits(spark, tmp_path, splits):
    path = tmp_path / "a.csv"
    path.write_bytes(b'id,t\r\n1,"' + b"x y\r\n" * 400 + b'"\r\n\r\n2,plain\r\n3,""\r\n')
    splits(100)
    got = {r.id: r.t for r in quoted_csv(spark, str(path)).collect()}
    assert got["1"] == "x y\r\n" * 400 and got["2"] == "plain" and not got["3"] and len(got) == 3


def test_only_a_header_and_no_quote_at_all(spark, tmp_path, splits):
    splits(20)
    (tmp_path / "h.csv").write_text("id,t\n")
    assert quoted_csv(spark, str(tmp_path / "h.csv")).collect() == []
    (tmp_path / "p.csv").write_text("id,t\n" + "".join(f"{i},v{i}\n" for i in range(100)))
    assert quoted_csv(spark, str(tmp_path / "p.csv")).count() == 100


def test_splits_inside_a_record():
    rows = [(1, 0, 3, True, True), (1, 10, 0, True, False), (1, 20, 2, True, False), (1, 30, 1, True, True), (2, 0, 2, True, False), (1, 40, 1, False, True)]
    assert carried(rows) == ({(1, 10): 0, (1, 20): 0, (1, 30): 0}, {(1, 0), (1, 40)})
