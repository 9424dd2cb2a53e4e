"""Benchmark decontamination: rare n-gram seeds join training passages to test items, then Smith-Waterman alignment.

Words are runs of letters and digits, lower-cased. A test item's seeds are its three-word windows whose words are
rare together: the product of their shares of all corpus words is at most ``SEED_SHARE``; an item always keeps its
``LEAST_SEEDS`` rarest. Rarity comes from single words, so a passage that leaked into many documents stays a seed.
Where a seed occurs in a document, the passage around it, an item long on either side, is aligned with the item word by
word. The score is the best local alignment over that of a verbatim copy. A pair is a leak from ``LEAK_SCORE`` if the
alignment is worth ``LEAK_WORDS`` equal words too, or all words of a shorter item.

Test items are taken in blocks of ``ITEMS_AT_ONCE``, so what goes to each task is bounded; each block reads the corpus.
Items with fewer than three words have no seeds and no leaks; null texts are empty. Repeated rows give repeated
results. Extra columns pass through where whole rows are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import PLACES, mix, text_chunks, word_hashes

SEED_WORDS = 3
SEED_SHARE = 1e-8
LEAST_SEEDS = 8
LEAK_SCORE = 0.5
LEAK_WORDS = 8
MATCH, MISMATCH, GAP = 2, -1, -1
ITEMS_AT_ONCE = 20_000
#: Words of passages that are aligned at a time; only bounds memory.
ALIGN_WORDS = 100_000
#: Leading bits of a hash that a first test looks at.
FILTER_BITS = 22

GAPS = np.ones(256, bool)
GAPS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LETTERS = np.arange(256, dtype=np.uint8)

LEAKS = "item_id long, score double, first_word long, last_word long"


def hashed_words(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for data, ends, _, _ in text_chunks(pc.utf8_lower(texts.cast(pa.large_string()))):
        yield word_hashes(data, ends, LETTERS, GAPS)


def windows(words: np.ndarray) -> np.ndarray:
    """Hash of the seed-long window that begins at each word."""
    size = len(words) - SEED_WORDS + 1
    out = np.zeros(max(0, size), np.uint64)
    for k in range(SEED_WORDS if size > 0 else 0):
        out += words[k : k + size] * PLACES[k]
    return mix(out)


class Items:
    """A block of test items with their seeds: plain arrays, sent to every task."""

    def __init__(self, ids: list[int], words: list[np.ndarray]):
        self.ids = np.array(ids, np.int64)
        self.words = words
        self.size = np.array([len(x) for x in words], np.int64)
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]))
        self.seeds = self.item = self.place = np.zeros(0, np.int64)

    def choose_seeds(self, counts: np.ndarray, total: int) -> None:
        """``counts``: how often each word of the vocabulary occurs in the corpus of ``total`` words."""
        log = np.log(np.maximum(counts, 0.5) / max(total, 1))
        seeds, item, place = [], [], []
        for k, words in enumerate(self.words):
            code = windows(words)
            if not len(code):
                continue
            share = log[np.searchsorted(self.vocabulary, words)]
            share = np.convolve(share, np.ones(SEED_WORDS), "valid")
            limit = max(np.log(SEED_SHARE), np.sort(share)[: LEAST_SEEDS][-1])
            chosen = np.flatnonzero(share <= limit)
            seeds.append(code[chosen])
            item.append(np.full(len(chosen), k))
            place.append(chosen)
        if seeds:
            order = np.argsort(np.concatenate(seeds), kind="stable")
            self.seeds = np.concatenate(seeds)[order]
            self.item, self.place = np.concatenate(item)[order], np.concatenate(place)[order]


def vocabulary_counts(vocabulary: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapper from texts to (place in the vocabulary, occurrences); place -1 counts all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = np.zeros(len(vocabulary), np.int64), 0
        maybe = presence(vocabulary)
        for batch in batches:
            for words, _ in hashed_words(batch.column("text")):
                total += len(words)
                words = words[maybe[words >> np.uint64(64 - FILTER_BITS)]]
                at = np.minimum(np.searchsorted(vocabulary, words), max(0, len(vocabulary) - 1))
                if len(vocabulary):
                    known += np.bincount(at[vocabulary[at] == words], minlength=len(vocabulary))
        some = np.flatnonzero(known)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(known[some], total))], ["place", "count"]
        )

    return run


def presence(codes: np.ndarray) -> np.ndarray:
    """Which leading bits occur among the codes: a quick first test."""
    out = np.zeros(1 << FILTER_BITS, bool)
    out[codes >> np.uint64(64 - FILTER_BITS)] = True
    return out


def align(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each pair of word sequences: its score, and its last place in ``b``.

    All pairs advance together, one word of ``a`` at a time; gaps along ``b`` are a running maximum.
    """
    rows, columns = max(map(len, a)), max(map(len, b))
    one, two = np.zeros((len(a), rows), np.uint64), np.zeros((len(a), columns), np.uint64)
    for k in range(len(a)):
        one[k, : len(a[k])] = a[k]
        two[k, : len(b[k])] = b[k]
    real = np.arange(columns) < np.array([len(x) for x in b])[:, None]
    slope = -GAP * np.arange(columns + 1)
    last = np.zeros((len(a), columns + 1), np.int64)
    best, end = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    for i in range(rows):
        inside = (i < np.array([len(x) for x in a]))[:, None]
        step = np.where((two == one[:, i : i + 1]) & real & inside, MATCH, MISMATCH)
        now = np.zeros_like(last)
        now[:, 1:] = np.maximum(np.maximum(last[:, :-1] + step, last[:, 1:] + GAP), 0)
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        top = now.argmax(axis=1)
        value = now[np.arange(len(a)), top]
        better = value > best
        best[better], end[better] = value[better], top[better] - 1
        last = now
    return best, end


def passages(items: Items, words: np.ndarray, counts: np.ndarray, maybe: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, item, first word, end) of the passages around seeds, one for seeds that lie half an item apart or less."""
    code = windows(words)
    at = np.flatnonzero(maybe[code >> np.uint64(64 - FILTER_BITS)]) if len(items.seeds) else np.zeros(0, np.int64)
    low = np.searchsorted(items.seeds, code[at])
    count = np.searchsorted(items.seeds, code[at], "right") - low
    ends = np.cumsum(counts)
    text = np.searchsorted(ends, at, "right")
    whole = at + SEED_WORDS <= ends[np.minimum(text, len(ends) - 1)]
    count[~whole] = 0
    seed = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    at, text = np.repeat(at, count), np.repeat(text, count)
    item = items.item[seed]
    begin = at - items.place[seed] - items.size[item]
    stop = np.minimum(begin + 3 * items.size[item], ends[text])
    inside = np.maximum(begin, (ends - counts)[text])
    found: list[tuple[int, int, int, int]] = []
    # Distances are of the begins as the seeds say: at a text's head the begins inside the text all fall together.
    kept = 0
    for k in np.lexsort((begin, item, text)).tolist():
        if not found or found[-1][:2] != (text[k], item[k]) or begin[k] > kept + items.size[item[k]] // 2:
            found.append((int(text[k]), int(item[k]), int(inside[k]), int(stop[k])))
            kept = int(begin[k])
    return found


def leaks(items: Items, column: pa.Array, maybe: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
    """(row, item id, score, first word, last word): the best passage of each row and item that is a leak."""
    row = 0
    for words, counts in hashed_words(column):
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        starts = np.cumsum(counts) - counts
        # By length, so that little of a block is filling.
        found = sorted(passages(items, words, counts, maybe), key=lambda x: x[3] - x[2])
        while found:
            fit = max(1, ALIGN_WORDS // (found[-1][3] - found[-1][2]))
            found, part = found[:-fit], found[-fit:]
            a = [items.words[item] for _, item, _, _ in part]
            b = [words[begin:stop] for _, _, begin, stop in part]
            score, end = align(a, b)
            size = items.size[[item for _, item, _, _ in part]]
            share = score / (MATCH * size)
            good = np.flatnonzero((share >= LEAK_SCORE) & (score >= MATCH * np.minimum(size, LEAK_WORDS)))
            if not len(good):
                continue
            _, back = align([a[k][::-1] for k in good], [b[k][: end[k] + 1][::-1] for k in good])
            for k, reach in zip(good.tolist(), back.tolist(), strict=True):
                text, item, begin, _ = part[k]
                last = begin + int(end[k]) - int(starts[text])
                now = (float(share[k]), last - reach, last)
                if now > best.get((text, item), (0.0, 0, 0)):
                    best[text, item] = now
        for (text, item), (share, first, last) in sorted(best.items()):
            yield row + text, int(items.ids[item]), share, first, last
        row += len(counts)


def leak_rows(items: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = presence(items.seeds.astype(np.uint64))
        for batch in batches:
            found = list(leaks(items, batch.column("text"), maybe))
            if found:
                row, item, score, first, last = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(row)), pa.array(item), pa.array(score), pa.array(first), pa.array(last)],
                    ["doc_id", "item_id", "score", "first_word", "last_word"],
                )

    return run


def clean_rows(items: Items) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = presence(items.seeds.astype(np.uint64))
        for batch in batches:
            stay = np.ones(batch.num_rows, bool)
            stay[[x[0] for x in leaks(items, batch.column("text").cast(pa.string()), maybe)]] = False
            yield batch.filter(pa.array(stay))

    return run


def item_blocks(documents: DataFrame, benchmark: DataFrame) -> Iterator[Items]:
    """The test items in blocks, with seeds chosen by the corpus's word counts."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    texts = documents.select(F.col("text").cast("string").alias("text"))
    for block in batched(rows.where("item_id is not null").toLocalIterator(), ITEMS_AT_ONCE):
        found = list(hashed_words(pa.array([row["text"] for row in block], pa.string())))
        words = [x for part, counts in found for x in np.split(part, np.cumsum(counts)[:-1])]
        items = Items([row["item_id"] for row in block], words)
        counted = texts.mapInArrow(vocabulary_counts(items.vocabulary), "place long, count long")
        counts, total = np.zeros(len(items.vocabulary)), 0
        for place, count in counted.groupBy("place").agg(F.sum("count")).collect():
            if place < 0:
                total = count
            else:
                counts[place] = count
        items.choose_seeds(counts, total)
        yield items


def found_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, item_id, score, first_word, last_word)``: every leak of an item into a document, at its best place."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    out = documents.sparkSession.createDataFrame([], f"doc_id {kind}, {LEAKS}")
    for items in item_blocks(documents, benchmark):
        out = out.unionByName(rows.mapInArrow(leak_rows(items), f"doc_id {kind}, {LEAKS}"))
    return out


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows into which no test item leaked."""
    for items in item_blocks(documents, benchmark):
        documents = documents.mapInArrow(clean_rows(items), documents.schema)
    return documents
