"""N-gram Jaccard join by token-combination prefixes.

Documents are sets of distinct five-word shingles (tokens). Two of them link when their Jaccard similarity is at least
0.8. A token's class is its document frequency: rare below ``FREQUENT`` documents, else frequent.

1. Every set posts its tokens under a number of its own, 64 bits of its fingerprint, packed into one block per input
   batch and hash bucket. Copies are dropped within a block and within a bucket, so lists and counts are of distinct
   sets, whatever rows repeat. A bucket sees whole posting lists, so it knows each token's class. Rare tokens are indexed alone: their short lists give pairs, with the number
   of rare tokens that the pair shares. For frequent tokens only the number in each document is kept,
   or more than that, up to all, for copies in several blocks: it is a bound.
2. A pair shares at most ``min(frequent_a, frequent_b)`` frequent tokens, so the count decides most pairs: certain,
   impossible, or open. Truncated tokens are used here; their width follows the corpus size.
3. A pair that shares no rare token can link only if both documents consist of frequent tokens to four fifths or more.
   Those documents count their tokens among themselves and order them by frequency level, then hash. The rarer ones
   are indexed alone. The others are dealt into classes by hash, as many as the document's size level asks for, and
   *pairs* of tokens of a class are indexed; the prefix is extended until it holds ``n // 5 + 1`` tokens beyond the
   first of each class. A partner misses at most ``n // 5`` tokens, so it shares a single token or a pair of one class.
4. In each list all members are verified with the member that has the fewest tokens of its own first. Only members
   whose components still differ after that are paired with the rest of the list. Nothing but the expansion of pairs
   inside a component is saved: the components are exact.

Empty and null texts have no tokens and link with nothing. Equal sets are one node, named by a 128-bit fingerprint, so
copies never multiply pairs. Rows may repeat: each gets its own result row. Unlike texts under one id are sets of
their own, which link like any others. A null id is kept; it never names a component. Extra columns are ignored. Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, staged
from .shingles import fingerprints, mix, shingle_sets

WIDTH = 5
#: Documents from which a token counts as frequent.
FREQUENT = 16
#: Tokens of one block of postings that a bucket holds, on average, over the corpus. Bounds a task's memory.
BUCKET_TOKENS = 2_000_000
#: Documents of one posting block: their place fits 12 bits. Bounds a task's memory.
BLOCK_DOCUMENTS = 1 << 12
#: Among documents of frequent tokens: tokens of fewer than 2 ** SINGLE_LEVEL of these are indexed alone.
SINGLE_LEVEL = 6
#: A token class of a size level holds about so many tokens of a document.
CLASS_TOKENS = 16

SETS = "key long, doc_id long, n long, node binary, number long"
BLOCKS = "bucket int, docs binary, low binary, high binary, place binary, over binary"
PARTS = "home int, kind int, block binary"
FOUND = "a long, b long, c long"


def numbers(names: np.ndarray) -> np.ndarray:
    """The number under which a set posts its tokens."""
    return np.ascontiguousarray(names[:, 0]).view(np.int64)


def set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = list(shingle_sets(batch.column("text"), WIDTH))
        if not parts:
            continue
        names = np.concatenate([fingerprints(*part) for part in parts])
        sizes = np.concatenate([counts for _, counts in parts])
        node = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(sizes), [None, pa.py_buffer(names.tobytes())])
        yield pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("doc_id"), pa.array(sizes, pa.int64()), node.cast(pa.binary()), pa.array(numbers(names))],
            ["key", "doc_id", "n", "node", "number"],
        )


def planes(values: np.ndarray) -> tuple[bytes, bytes]:
    """The low 16 bits as they are, and the higher ones, which are mostly zero, packed."""
    parts = values.astype("<u8").view("<u2").reshape(-1, 4)
    return parts[:, 0].tobytes(), zlib.compress(parts[:, 1:].T.tobytes(), 1)


def unplanes(low: bytes, high: bytes) -> np.ndarray:
    parts = np.empty((len(low) // 2, 4), "<u2")
    parts[:, 0] = np.frombuffer(low, "<u2")
    parts[:, 1:] = np.frombuffer(zlib.decompress(high), "<u2").reshape(3, -1).T
    return parts.view("<u8").ravel()


def posting_blocks(buckets: int, bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapper from texts to one block per bucket. ``bits``: of a truncated token, 48 at most."""
    place_bits = np.uint64(12)
    high_bits = np.uint64(bits - int(math.log2(buckets)))

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple]:
        parts = list(shingle_sets(batch.column("text"), WIDTH))
        tokens = np.concatenate([t for t, _ in parts]) >> np.uint64(64 - bits)
        counts = np.concatenate([c for _, c in parts])
        keys = numbers(np.concatenate([fingerprints(*part) for part in parts]))
        one = np.zeros(len(keys), bool)
        one[np.unique(keys, return_index=True)[1]] = True
        tokens, counts, keys = tokens[np.repeat(one, counts)], counts[one], keys[one]
        place = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
        packed = (((tokens % buckets) << high_bits | tokens // buckets) << place_bits) | place
        packed.sort()
        token = packed >> place_bits
        place = (packed & np.uint64(BLOCK_DOCUMENTS - 1)).astype("<u2")
        at = np.arange(len(token))
        begins = np.ones(len(token), bool)
        begins[1:] = token[1:] != token[:-1]
        kept = at - np.maximum.accumulate(np.where(begins, at, 0)) < FREQUENT
        # A token that is frequent in this block alone is frequent: later postings are only counted.
        over = np.bincount(place[~kept], minlength=len(counts)).astype("<i4")
        token, place = token[kept], place[kept]
        home = int(keys[0]) % buckets
        bucket = token >> high_bits
        cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        token &= (np.uint64(1) << high_bits) - np.uint64(1)
        for k in range(buckets):
            low, high = cuts[k], cuts[k + 1]
            here = over > 0 if k == home else np.zeros(len(counts), bool)
            extra = here.any()
            here[place[low:high]] = True
            if here.any():
                docs = zlib.compress(keys[here].astype("<i8").tobytes() + counts[here].astype("<i4").tobytes(), 1)
                steps = np.diff(token[low:high], prepend=np.uint64(0))
                at = (np.cumsum(here) - 1).astype("<u2")[place[low:high]]
                yield k, docs, *planes(steps), at.tobytes(), zlib.compress(over[here].tobytes(), 1) if extra else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_DOCUMENTS):
                rows = list(zip(*blocks(batch.slice(low, BLOCK_DOCUMENTS)), strict=True))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows[0], pa.int32()), *(pa.array(x, pa.binary()) for x in rows[1:])],
                        ["bucket", "docs", "low", "high", "place", "over"],
                    )

    return run


def posting_lists(blocks: pa.Table, homes: int) -> pa.Table:
    """All postings of one bucket to the pairs that share rare tokens, and the number of each document's frequent ones.

    Both go on in packed blocks, dealt by the first document.
    """
    keys, sizes, tokens, owners, over = [], [], [], [], []
    for row in blocks.to_pylist():
        head = zlib.decompress(row["docs"])
        count = len(head) // 12
        base = sum(map(len, keys))
        keys.append(np.frombuffer(head, "<i8", count))
        sizes.append(np.frombuffer(head, "<i4", count, 8 * count))
        tokens.append(np.cumsum(unplanes(row["low"], row["high"]), dtype=np.uint64))
        owners.append(np.frombuffer(row["place"], "<u2").astype(np.int64) + base)
        over.append(np.frombuffer(zlib.decompress(row["over"]), "<i4") if row["over"] else np.zeros(count, "<i4"))
    key, first, same = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    size, frequent = np.concatenate(sizes)[first], np.zeros(len(key), np.int64)
    np.add.at(frequent, same, np.concatenate(over))
    token, owner = np.concatenate(tokens), same[np.concatenate(owners)]
    if len(key) == len(same):
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
    else:
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        once = np.ones(len(token), bool)
        once[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[once], owner[once]
    begins = np.ones(len(token), bool)
    begins[1:] = token[1:] != token[:-1]
    starts = np.flatnonzero(begins)
    length = np.diff(starts, append=len(token))
    common = np.repeat(length >= FREQUENT, length)
    frequent += np.bincount(owner[common], minlength=len(key))
    rare = np.repeat((length > 1) & (length < FREQUENT), length)
    token, owner = token[rare], owner[rare]
    pairs = []
    for step in range(1, FREQUENT - 1):
        a, b = owner[:-step], owner[step:]
        same = token[:-step] == token[step:]
        a, b = a[same], b[same]
        near = (5 * np.minimum(size[a], size[b]) >= 4 * np.maximum(size[a], size[b])) & (a != b)
        a, b = a[near], b[near]
        pairs.append(np.minimum(a, b) << 32 | np.maximum(a, b))
    pair, shared = np.unique(np.concatenate(pairs), return_counts=True)
    some = np.flatnonzero(frequent)
    out = []
    for kind, columns in enumerate(
        ((key[some], frequent[some]), (key[pair >> 32], key[pair & 0xFFFFFFFF], shared))
    ):
        home = (mix(columns[0].astype(np.uint64)) % np.uint64(homes)).astype(np.int32)
        order = np.argsort(home, kind="stable")
        cuts = np.searchsorted(home[order], np.arange(homes + 1))
        for k in np.unique(home).tolist():
            part = order[cuts[k] : cuts[k + 1]]
            out.append((k, kind, zlib.compress(np.stack([x[part] for x in columns]).astype("<i8").tobytes(), 1)))
    home, kind, block = zip(*out, strict=True) if out else ((), (), ())
    return pa.table([pa.array(home, pa.int32()), pa.array(kind, pa.int32()), pa.array(block, pa.binary())], ["home", "kind", "block"])


def summed(parts: pa.Table) -> pa.Table:
    """Adds up what the buckets found: (a, null, frequent tokens) of a document, (a, b, shared rare tokens) of a pair."""
    out = []
    for kind in (0, 1):
        blocks = [np.frombuffer(zlib.decompress(x["block"]), "<i8") for x in parts.to_pylist() if x["kind"] == kind]
        rows = np.concatenate([x.reshape(kind + 2, -1) for x in blocks], axis=1) if blocks else np.zeros((kind + 2, 0), np.int64)
        order = np.lexsort(rows[:-1])
        rows = rows[:, order]
        begins = np.ones(len(order), bool)
        begins[1:] = (rows[:-1, 1:] != rows[:-1, :-1]).any(axis=0)
        starts = np.flatnonzero(begins)
        c = np.add.reduceat(rows[-1], starts) if len(starts) else rows[-1]
        b = pa.array(rows[1, starts]) if kind else pa.nulls(len(starts), pa.int64())
        out.append(pa.table([pa.array(rows[0, starts]), b, pa.array(c)], ["a", "b", "c"]))
    return pa.concat_tables(out)


def token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, wanted, n, frequent, text) to (node, n, frequent, tokens)."""
    for batch in batches:
        parts = list(shingle_sets(batch.column("text"), WIDTH))
        if not parts:
            continue
        names = np.concatenate([fingerprints(*part) for part in parts])
        stored = [t.tobytes() for tokens, counts in parts for t in np.split(tokens, np.cumsum(counts)[:-1])]
        wanted = batch.column("node").to_pylist()
        right = pa.array([names[k].tobytes() == wanted[k] for k in range(len(wanted))])
        out = [batch.column("node"), batch.column("n"), batch.column("frequent"), pa.array(stored, pa.binary())]
        yield pa.RecordBatch.from_arrays(out, ["node", "n", "frequent", "tokens"]).filter(right)


def exploded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uid, tokens in zip(batch.column("uid"), batch.column("tokens"), strict=True):
            found = pa.array(np.frombuffer(tokens.as_buffer(), np.int64))
            yield pa.RecordBatch.from_arrays([pa.repeat(uid, len(found)), found], ["uid", "token"])


def signatures(level: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of what a document indexes, and whether each is a combination.

    ``level`` and ``token`` are in the common order: the tokens' frequency level, then their hash. For both size levels
    that a partner may share, the prefix is extended until it holds ``n // 5 + 1`` tokens beyond the first of each
    frequent class; its single tokens below ``SINGLE_LEVEL`` and all pairs within a class are indexed.
    """
    n = len(token)
    out, single = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for size in {n.bit_length(), (-(-4 * n // 5)).bit_length()}:
        classes = max(1, (1 << (size - 1)) // CLASS_TOKENS)
        kind = (mix(token + np.uint64(size)) % np.uint64(classes)).astype(np.int64)
        kind[level < SINGLE_LEVEL] = -1
        first = np.zeros(n, bool)
        first[np.unique(kind, return_index=True)[1]] = True
        first &= kind >= 0
        stop = int(np.searchsorted(np.cumsum(~first), n // 5 + 1)) + 1
        part, prefix = kind[:stop], token[:stop]
        single.append(mix(prefix[part < 0]))
        order = np.argsort(part, kind="stable")
        order = order[part[order] >= 0]
        part, prefix = part[order], prefix[order]
        for step in range(1, len(part)):
            same = part[:-step] == part[step:]
            if not same.any():
                break
            one, two = prefix[:-step][same], prefix[step:][same]
            low, high = np.minimum(one, two), np.maximum(one, two)
            out.append(mix(mix(low + np.uint64(size)) + np.uint64(3) * high))
    pairs, singles = np.unique(np.concatenate(out)), np.unique(np.concatenate(single))
    return np.concatenate([singles, pairs]), np.arange(len(singles) + len(pairs)) >= len(singles)


def signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, n, frequent, items) to (sig, uid, n, bound); bound: how many tokens the partners in this list may share."""
    for batch in batches:
        items = batch.column("items")
        for row in range(batch.num_rows):
            found = items[row].values
            level = found.field("level").to_numpy(zero_copy_only=False)
            token = found.field("token").to_numpy(zero_copy_only=False).view(np.uint64)
            sig, combined = signatures(level, token)
            bound = np.where(combined, (level >= SINGLE_LEVEL).sum(), batch.column("frequent")[row].as_py())
            rest = [pa.repeat(batch.column(name)[row], len(sig)) for name in ("uid", "n")]
            if len(sig):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig.view(np.int64)), *rest, pa.array(bound, pa.int64())], ["sig", "uid", "n", "bound"]
                )


def verified_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("tokens_a"), batch.column("tokens_b"), strict=True):
            a, b = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
            both = np.concatenate([a, b])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            keep.append(100 * shared >= 80 * (len(a) + len(b) - shared))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame, by: str) -> DataFrame:
    """Pairs (a, b) of nodes whose similarity reaches the threshold; ``by`` names the column that pairs use."""
    one = sets.select(F.col(by).alias("x"), F.col("node").alias("a"), F.col("tokens").alias("tokens_a"))
    two = sets.select(F.col(by).alias("y"), F.col("node").alias("b"), F.col("tokens").alias("tokens_b"))
    joined = pairs.join(two, "y").join(one, "x").select("a", "b", "tokens_a", "tokens_b")
    return joined.mapInArrow(verified_rows, "a binary, b binary")


def joined_groups(groups: DataFrame, more: DataFrame) -> DataFrame:
    """``(node, component)`` after more links ``(a, b)``: only the components that these join are looked at again."""
    label = groups.select(F.col("node").alias("end"), F.col("component").alias("label"))
    ends = more
    for side in "ab":
        ends = ends.join(label, F.col(side) == F.col("end"), "left").withColumn(side, F.coalesce("label", side))
        ends = ends.select("a", "b")
    joined = components(ends)
    onward = joined.select(F.col("node").alias("component"), F.col("component").alias("onward"))
    known = groups.join(onward, "component", "left").select("node", F.coalesce("onward", "component").alias("component"))
    return known.unionByName(joined.join(groups, "node", "left_anti"))


def row_key() -> Column:
    """A number for id and text together: an id may stand at any number of unlike texts."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def jaccard_components(documents: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``documents(doc_id, text)``."""
    return row_components(documents).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def row_components(documents: DataFrame) -> DataFrame:
    """``(key, doc_id, n, component, component_id)`` for every row of ``documents(doc_id, text)``.

    ``component`` is a node of the component, null for a text without tokens; an id may name several components.
    """
    texts = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    texts = texts.withColumn("key", row_key())
    docs = staged(texts.mapInArrow(set_rows, SETS), "sets")
    total = docs.agg(F.sum("n")).first()[0] or 0
    if not total:
        none = F.lit(None).cast("binary").alias("component")
        return docs.select("key", "doc_id", "n", none, F.col("doc_id").alias("component_id"))
    buckets = max(8, -(-total // BUCKET_TOKENS))
    bits = min(48, 17 + max(15, total.bit_length()))
    blocks = texts.select("text").mapInArrow(posting_blocks(buckets, bits), BLOCKS)
    parts = blocks.groupBy("bucket").applyInArrow(lambda found: posting_lists(found, buckets), PARTS)
    found = staged(parts.groupBy("home").applyInArrow(summed, FOUND), "found")

    nodes = docs.where("n > 0").groupBy("node").agg(*(F.min(x).alias(x) for x in ("number", "n", "key")))
    nodes = nodes.join(
        found.where("b is null").groupBy(F.col("a").alias("number")).agg(F.sum("c").alias("frequent")), "number", "left"
    )
    nodes = nodes.withColumn("frequent", F.least("n", F.coalesce("frequent", F.lit(0))))
    nodes = staged(nodes.select("number", "node", "n", "key", "frequent"), "nodes")
    pairs = found.where("b is not null").groupBy("a", "b").agg(F.sum("c").alias("c"))
    for side in "ab":
        ends = nodes.select(*(F.col(x).alias(f"{x}_{side}") for x in ("number", "node", "n", "frequent")))
        pairs = pairs.join(ends, F.col(side) == F.col(f"number_{side}"))
    least = F.expr("4 * (n_a + n_b)")
    pairs = pairs.select(
        F.least("node_a", "node_b").alias("a"),
        F.greatest("node_a", "node_b").alias("b"),
        (9 * F.col("c") >= least).alias("sure"),
        (9 * (F.col("c") + F.least("frequent_a", "frequent_b")) >= least).alias("open"),
    )
    pairs = staged(pairs.where("open").select("a", "b", "sure"), "pairs")
    wanted = pairs.where("not sure").select(F.explode(F.array("a", "b")).alias("node")).distinct()
    by_node = nodes.drop("number").join(wanted.withColumn("asked", F.lit(True)), "node", "left").where(
        "asked or (n > 1 and 5 * frequent >= 4 * n)"
    )
    needed = texts.select("key", "text").join(by_node.drop("asked"), "key")
    sets = needed.mapInArrow(token_rows, "node binary, n long, frequent long, tokens binary").groupBy("node").agg(
        *(F.first(x).alias(x) for x in ("n", "frequent", "tokens"))
    )
    sets = staged(sets.withColumn("uid", F.monotonically_increasing_id()), "tokens")

    common = sets.where("n > 1 and 5 * frequent >= 4 * n").select("uid", "n", "frequent", "tokens")
    owned = common.mapInArrow(exploded_rows, "uid long, token long")
    level = owned.groupBy("token").agg(F.floor(F.log2(F.count("*"))).cast("int").alias("level"))
    items = owned.join(level, "token").groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("level", "token"))).alias("items"))
    lists = common.drop("tokens").join(items, "uid").mapInArrow(signature_rows, "sig long, uid long, n long, bound long")
    lists = staged(lists, "lists")
    # The member with the fewest words of its own leads a list.
    lead = lists.groupBy("sig").agg(
        F.max(F.struct((F.col("bound") / F.col("n")).alias("share"), "n", "uid", "bound")).alias("lead"),
        F.count("*").alias("members"),
    )
    led = lists.join(lead.where("members > 1"), "sig").where(
        "uid <> lead.uid and 9 * least(bound, lead.bound) >= 4 * (n + lead.n)"
    )
    led = staged(led.select(F.least("uid", "lead.uid").alias("x"), F.greatest("uid", "lead.uid").alias("y")).distinct(), "led")
    named = pairs.where("not sure").select(F.col("a").alias("x"), F.col("b").alias("y"))
    links = staged(
        pairs.where("sure").select("a", "b")
        .unionByName(verified(named, sets, "node"))
        .unionByName(verified(led, sets, "uid")),
        "links",
    )
    groups = components(links)

    # Members of one list that are still apart.
    labelled = lists.join(
        sets.join(groups, "node", "left").select("uid", F.coalesce("component", "node").alias("label")), "uid"
    )
    parts = labelled.groupBy("sig", "label").agg(F.count("*").alias("members"))
    mixed = parts.groupBy("sig").agg(
        F.max(F.struct("members", "label"))["label"].alias("most"), F.count("*").alias("labels")
    )
    apart = staged(
        labelled.join(mixed.where("labels > 1").drop("labels"), "sig"), "apart"
    )
    few = apart.where("label <> most").select("sig", *(F.col(x).alias(f"{x}_") for x in ("uid", "n", "bound", "label")))
    rest = few.join(apart, "sig").where(
        "label <> label_ and 9 * least(bound, bound_) >= 4 * (n + n_) and (label = most or uid < uid_)"
    )
    rest = rest.select(F.least("uid", "uid_").alias("x"), F.greatest("uid", "uid_").alias("y")).distinct()
    rest = staged(rest, "rest")
    more = staged(verified(rest.join(led, ["x", "y"], "left_anti"), sets, "uid"), "links")
    if more.limit(1).count():
        groups = joined_groups(groups, more)

    smallest = docs.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("smallest")).join(groups, "node", "left")
    smallest = smallest.select("node", "smallest", F.coalesce("component", "node").alias("component"))
    named = smallest.groupBy("component").agg(F.min("smallest").alias("component_id"))
    by_node = smallest.join(named, "component").select("node", "component", "component_id")
    # Texts without words share a node, but no component: they stay out of the join.
    empty = docs.where("n = 0").select("key", "doc_id", "n", F.lit(None).cast("binary").alias("component"), F.col("doc_id").alias("component_id"))
    some = docs.where("n > 0").join(by_node, "node", "left")
    return some.select("key", "doc_id", "n", "component", F.coalesce("component_id", "doc_id").alias("component_id")).unionByName(empty)
