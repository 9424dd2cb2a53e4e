"""Minimax contiguous partition into shards.

Rows with equal texts are an atomic group. Groups are ordered by a 64-bit hash of their text, and this sequence is cut
into ``SHARDS`` runs whose largest one is as small as possible: a binary search over the shard capacity, each try
checked greedily from the left.

The sequence is never gathered. The driver sees sums over aligned intervals of the hash, a few thousand at first. For
any capacity the greedy cuts over these sums are bounded from both sides: from below by cutting only between intervals,
from above by filling an interval to any point. Only intervals that may still hold a cut are split further, by one
aggregate per round, until every cut that matters lies between single groups. The capacity found is the exact optimum.
Within it each cut lies next to the even share of what is left, so that one huge group does not let the other shards
differ; if that leaves too much for the last shard, the greedy cuts hold.

Sizes are UTF-8 bytes plus ``ROW_BYTES``. Null texts are empty, and one group with empty ones. Slots are gapless in each
shard; their order within a shard carries no meaning. Repeated rows each get a slot. Empty tables give no rows; with
fewer groups than shards some shards stay empty. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

SHARDS = 40
ROW_BYTES = 16
#: Bits of the hash that the first sums go by, and those that each round adds.
FIRST_BITS, MORE_BITS = 12, 6
#: Rows of one shard that are numbered together.
NUMBERED_TOGETHER = 50_000

#: An interval: first hash (from 0), bits that name it, bytes, groups.
Interval = tuple[int, int, int, int]


def sums(groups: DataFrame, bits: int, inside: list[int] | None = None) -> list[Interval]:
    """Sums over the intervals that the leading ``bits`` name; ``inside``: only within these coarser ones."""
    if inside is not None:
        groups = groups.where(F.shiftrightunsigned("key", 64 - bits + MORE_BITS).isin(inside))
    rows = groups.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("lead")).agg(F.sum("size"), F.count("*")).collect()
    return [(lead << (64 - bits), bits, size, count) for lead, size, count in rows]


def pessimist(bounds: list[int], capacity: int, shards: int) -> list[int]:
    """Greedy cuts between intervals only, as bytes passed; never beyond the true ones."""
    at, out = 0, []
    for _ in range(shards):
        at = bounds[bisect_right(bounds, at + capacity) - 1]
        out.append(at)
    return out


def optimist(bounds: list[int], single: list[bool], capacity: int, shards: int) -> list[int]:
    """Greedy cuts that may fall anywhere inside an interval of several groups; never before the true ones."""
    at, out = 0, []
    for _ in range(shards):
        at = min(at + capacity, bounds[-1])
        k = bisect_right(bounds, at) - 1
        if k < len(single) and single[k]:
            at = bounds[k]
        out.append(at)
    return out


def least(low: int, high: int, fits) -> int:
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    return low


def evenly(bounds: list[int], capacity: int, shards: int) -> tuple[list[int], list[int]]:
    """Cuts next to the even share of what is left, within the capacity, and the intervals that these shares fall into."""
    at, out, met = 0, [], []
    for left in range(shards, 1, -1):
        share = at + (bounds[-1] - at) // left
        k = max(1, bisect_left(bounds, share))
        met.append(k - 1)
        near = [x for x in (bounds[k - 1], bounds[k]) if at < x <= at + capacity]
        at = min(near, key=lambda x: abs(x - share)) if near else bounds[bisect_right(bounds, at + capacity) - 1]
        out.append(at)
        if at == bounds[-1]:
            break
    return [*out, *[bounds[-1]] * (shards - 1 - len(out))], met


def split(groups: DataFrame, atoms: list[Interval], chosen: set[int]) -> list[Interval]:
    kept = [atom for k, atom in enumerate(atoms) if k not in chosen]
    for bits in sorted({atoms[k][1] for k in chosen}):
        inside = [atoms[k][0] >> (64 - bits) for k in chosen if atoms[k][1] == bits]
        kept += sums(groups, bits + MORE_BITS, inside)
    return sorted(kept)


def cuts(groups: DataFrame, shards: int) -> list[int]:
    """The first hash, from 0, of every shard but the first; ``groups(key, size)`` has one row for each group."""
    largest = groups.agg(F.max("size")).first()[0]
    if largest is None:
        return []
    atoms, capacity = sorted(sums(groups, FIRST_BITS)), 0
    while True:
        bounds = [0]
        for atom in atoms:
            bounds.append(bounds[-1] + atom[2])
        single = [atom[3] == 1 for atom in atoms]
        chosen = set()
        if not capacity:
            high = least(largest, bounds[-1], lambda c: pessimist(bounds, c, shards)[-1] == bounds[-1])
            low = least(largest, high, lambda c: optimist(bounds, single, c, shards)[-1] == bounds[-1])
            early, late = pessimist(bounds, low, shards), optimist(bounds, single, high, shards)
            for first, last in zip(early, late, strict=True):
                reach = range(bisect_right(bounds, first) - 1, min(bisect_left(bounds, last) + 1, len(atoms)))
                chosen.update(k for k in reach if not single[k])
            if not chosen:
                capacity = high
        if capacity:
            found, met = evenly(bounds, capacity, shards)
            chosen.update(k for k in met if not single[k])
        if not chosen:
            if bounds[-1] - (found or [0])[-1] > capacity:
                found = pessimist(bounds, capacity, shards)[:-1]
            return [atoms[bisect_left(bounds, at)][0] if at < bounds[-1] else 1 << 64 for at in found]
        atoms = split(groups, atoms, chosen)


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)`` for every row of ``documents(doc_id, text)``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        "doc_id",
        (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    rows = staged(rows, "rows")
    groups = staged(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    # Unsigned order of the hash: the sign bit is turned over to compare.
    signed = [found - (1 << 63) for found in cuts(groups, shards) if found < 1 << 64]
    turned = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
    shard = sum(((turned >= F.lit(cut)).cast("int") for cut in signed), F.lit(0))
    parts = max(1, -(-rows.count() // (shards * NUMBERED_TOGETHER)))
    rows = rows.withColumn("shard", shard).withColumn("part", F.pmod(F.xxhash64("doc_id", "size"), F.lit(parts)))
    counted = rows.groupBy("shard", "part").agg(F.count("*").alias("found"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("shard", "part", F.coalesce(F.sum("found").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "size", "key"))
    numbered = rows.withColumn("within", within).join(starts, ["shard", "part"])
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.col("within") - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
