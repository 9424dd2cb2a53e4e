"""The cuts against a search over the whole sequence."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from duewatch.llm.sharding import ROW_BYTES, sharded


def best_capacity(df, shards):
    text = F.coalesce("text", F.lit(""))
    groups = df.select(F.xxhash64(text).alias("key"), F.octet_length(text).alias("size")).groupBy("key").agg(
        F.sum(F.col("size") + ROW_BYTES).alias("size")
    )
    sizes = [r["size"] for r in sorted(groups.collect(), key=lambda r: r["key"] % (1 << 64))]
    low, high = max(sizes), sum(sizes)
    while low < high:
        middle, used, filled = (low + high) // 2, 1, 0
        for size in sizes:
            if filled + size > middle:
                used, filled = used + 1, 0
            filled += size
        low, high = (low, middle) if used <= shards else (middle + 1, high)
    return low


@pytest.mark.parametrize("shards", [1, 7, 40])
def test_largest_shard_is_minimal_and_groups_hold(make, shards):
    rows = [(k, f"text {k * k}" * (1 + k * 7 % 31)) for k in range(1500)]
    rows += [(2000 + k, "the same text") for k in range(900)] + [(None, None), (3, ""), (3, "é"), (3, "é"), (4, "z" * 50_000)]
    df = make(rows, 8)
    found = sharded(df, shards).collect()
    assert len(found) == len(rows)
    by_shard, by_text, slots = defaultdict(int), defaultdict(set), defaultdict(list)
    for r in found:
        by_shard[r.shard] += r["size"]
        by_text[r.text_crc32, r["size"]].add(r.shard)
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    assert max(by_shard.values()) == best_capacity(df, shards)
    assert all(len(x) == 1 for x in by_text.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_empty_and_tiny(make):
    assert sharded(make([])).collect() == []
    assert {r.slot for r in sharded(make([(1, "a"), (2, None)])).collect()} == {0}
