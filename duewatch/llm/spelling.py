"""Spelling variant grouping with k-d trees over letter counts.

Words are counted over the whole corpus. Two words are near if one inserted, deleted or replaced letter turns one into
the other, so their letter-count vectors are at most two apart in L1 (one, if their lengths differ). For each pair of
lengths (L, L) and (L, L+1) the shorter words search the longer ones' vectors within that distance, in two levels:

* a k-d tree of each length, cut from a sample of at most about ``SAMPLE`` vectors, deals the words into cells. A word is
  a point of one cell and a question to every cell whose box is near enough. Cells that the sample expects to be
  larger than ``CELL_WORDS`` (many words with equal counts cannot be cut) are split by hash, so no task holds more;
* in each cell a k-d tree with tight boxes prunes the questions down to leaves. What is left is compared by a 64-bit
  count signature, and the order of the letters decides.

Pairs never leave a task: it returns, for each word, how many near words it saw and the best. A word's form is its near
word of largest n if that is at least ``TIMES`` its own n; n grows by that factor along forms, so a few rounds of
pointer doubling reach the last one.

The sample only places the cuts; every word is in a cell and every cell that can hold a near word is asked. Null and
empty texts have no words. A row without ``doc_id`` has no letter deleted. Repeated rows count as often as they occur;
extra columns are ignored; of words with equal n the smaller one is the form. Empty tables give an empty result. Words
of any length are taken; a task holds the words of its cell.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

MIN_LETTERS, MIN_COUNT, TIMES = 6, 5, 5
#: One run of letters in so many (by the checksum of id and run) loses a letter before counting.
DAMAGED = 199
LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
#: About as many words' vectors are sampled to place the cells' borders.
SAMPLE = 1 << 16
#: Words and questions of a cell that one task takes; only bounds memory.
CELL_WORDS, CELL_QUESTIONS = 50_000, 200_000
#: A cut needs this many sampled vectors on both sides together.
CUT_FROM = 32
LEAF = 128
#: Dimensions of a vector: a to z, and six for the accented letters. Counts above this are taken as this.
DIMENSIONS, MOST = 32, 120
#: Words whose counts a task holds; pairs of words, and of letters, compared at a time. They only bound memory.
HELD_WORDS, PAIRS_AT_ONCE, LETTERS_AT_ONCE = 200_000, 1 << 20, 1 << 22

KIND = np.zeros(256, np.int64)
KIND[0x61:0x7B] = np.arange(26)
KIND[0xC0:] = 26 + np.arange(64) % 6


# --- counting


def damaged(doc_id: int, run: str) -> str:
    """The run, without one letter if its checksum says so."""
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``(doc_id, text)`` to partial counts ``(word, n)``; words in Latin-1."""
    counts: Counter[str] = Counter()

    def flushed() -> pa.RecordBatch:
        words = pa.array([w.encode("latin-1") for w in counts], pa.binary())
        out = pa.RecordBatch.from_arrays([words, pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            if not text.is_valid:
                continue
            lowered = text.as_buffer().to_pybytes().lower().decode()  # of bytes: only A-Z
            for run, n in Counter(LETTERS.findall(lowered)).items():
                if len(run) >= MIN_LETTERS:
                    word = run if doc_id is None else damaged(doc_id, run)
                    if len(word) >= MIN_LETTERS:
                        counts[word] += n
            if len(counts) >= HELD_WORDS:
                yield flushed()
    if counts:
        yield flushed()


def vocabulary(documents: DataFrame) -> DataFrame:
    """``(word, n)``: the words that are long and frequent enough, in Latin-1."""
    rows = documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    counted = rows.mapInArrow(count_rows, "word binary, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


# --- vectors and trees


def letters_of(words: list[bytes], length: int) -> np.ndarray:
    """Words of one length as rows of bytes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length)


def vectors(letters: np.ndarray) -> np.ndarray:
    """Letter counts of each row. Folding and capping counts can only bring two vectors nearer."""
    n = len(letters)
    at = KIND[letters] + np.arange(n)[:, None] * DIMENSIONS
    counts = np.bincount(at.ravel(), minlength=n * DIMENSIONS).reshape(n, DIMENSIONS)
    return np.minimum(counts, MOST).astype(np.int16)


def signatures(counts: np.ndarray) -> np.ndarray:
    """64 bits for each vector: two a dimension, one more set for each of the first two letters of a kind.

    The number of bits in which two signatures differ is at most their L1 distance.
    """
    bits = np.zeros(len(counts), np.uint64)
    for d in range(DIMENSIONS):
        for at_least in (1, 2):
            bits |= (counts[:, d] >= at_least).astype(np.uint64) << np.uint64(2 * d + at_least - 1)
    return bits


def widest(counts: np.ndarray) -> tuple[int, int] | None:
    """The dimension of largest variance and where to cut it, both sides nonempty; None if all are equal."""
    spread = counts.var(axis=0)
    dim = int(spread.argmax())
    if not spread[dim]:
        return None
    values = counts[:, dim]
    cut = int(np.median(values))
    return dim, cut if cut < values.max() else int(values[values < values.max()].max())


class Cells:
    """The upper k-d tree of one length: cuts, and the expected size of each cell."""

    def __init__(self, sample: np.ndarray, each: float):
        self.sample, self.each = sample, each
        self.cuts: list[tuple[int, int, int, int]] = []  # dimension, last value on the left, left, right
        self.parts: list[int] = []
        self.root = self._grown(sample, each)

    def _grown(self, sample: np.ndarray, each: float) -> int:
        """The number of the node for the sample; cells count down from -1."""
        cut = widest(sample) if len(sample) * each > CELL_WORDS and len(sample) >= CUT_FROM else None
        if cut is None:
            self.parts.append(max(1, math.ceil(len(sample) * each / CELL_WORDS)))
            return -len(self.parts)
        at = len(self.cuts)
        self.cuts.append((*cut, 0, 0))
        left = sample[:, cut[0]] <= cut[1]
        self.cuts[at] = (*cut, self._grown(sample[left], each), self._grown(sample[~left], each))
        return at

    def bare(self) -> Cells:
        """Without the sample, as tasks need it."""
        self.sample = self.sample[:0]
        return self

    def dealt(self, counts: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray]]:
        """Cells, each with the rows of ``counts`` that lie within ``reach`` of its box (0: in it)."""
        far = np.zeros((len(counts), DIMENSIONS), np.int16)
        todo = [(self.root, np.arange(len(counts)), far)]
        while todo:
            node, rows, far = todo.pop()
            if node < 0:
                yield -node - 1, rows
                continue
            dim, last, left, right = self.cuts[node]
            value = counts[rows, dim]
            for child, over in ((left, value - last), (right, last + 1 - value)):
                beyond = far.copy()
                beyond[:, dim] = np.maximum(beyond[:, dim], over)
                near = beyond.sum(axis=1) <= reach
                if near.any():
                    todo.append((child, rows[near], beyond[near]))


class Tree:
    """A k-d tree over the vectors of a cell, with the tight box of each node."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        self.leaves: list[np.ndarray] = []
        self.nodes: list[tuple[np.ndarray, np.ndarray, int, int]] = []  # low, high, left, right
        self._grown(np.arange(len(counts)))

    def _grown(self, rows: np.ndarray) -> int:
        own = self.counts[rows]
        at = len(self.nodes)
        cut = widest(own) if len(rows) > LEAF else None
        self.nodes.append((own.min(axis=0), own.max(axis=0), -1, len(self.leaves)))
        if cut is None:
            self.leaves.append(rows)
        else:
            left = own[:, cut[0]] <= cut[1]
            self.nodes[at] = (*self.nodes[at][:2], self._grown(rows[left]), self._grown(rows[~left]))
        return at

    def near(self, asked: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Leaves' rows, each with the questions within ``reach`` of the leaf's box."""
        todo = [(0, np.arange(len(asked)))]
        while todo:
            node, rows = todo.pop()
            low, high, left, right = self.nodes[node]
            own = asked[rows]
            rows = rows[(np.maximum(low - own, 0) + np.maximum(own - high, 0)).sum(axis=1) <= reach]
            if not len(rows):
                continue
            if left < 0:
                yield self.leaves[right], rows
            else:
                todo += [(left, rows), (right, rows)]


def one_edit(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Row by row: whether one replaced letter (equal lengths) or one inserted letter leads from one to the other."""
    if shorter.shape[1] == longer.shape[1]:
        return (shorter != longer).sum(axis=1) == 1
    length = shorter.shape[1]
    same = np.logical_and.accumulate(shorter == longer[:, :length], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((shorter == longer[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return same + tail >= length


def near_pairs(asked: np.ndarray, letters: np.ndarray, tree: Tree, signs: np.ndarray):
    """``(question, point)`` for all near pairs, as arrays, some at a time."""
    counts = vectors(asked)
    own = signatures(counts)
    reach = 2 if asked.shape[1] == letters.shape[1] else 1
    for points, rows in tree.near(counts, reach):
        step = max(1, PAIRS_AT_ONCE // len(points))
        for low in range(0, len(rows), step):
            some = rows[low : low + step]
            apart = np.bitwise_count(own[some][:, None] ^ signs[points][None, :])
            i, j = np.nonzero(apart <= reach)
            i, j = some[i], points[j]
            at_once = max(1, LETTERS_AT_ONCE // asked.shape[1])
            for first in range(0, len(i), at_once):
                a, b = i[first : first + at_once], j[first : first + at_once]
                near = one_edit(asked[a], letters[b])
                yield a[near], b[near]


# --- the search on Spark


def length_groups(words: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(sizes).tolist():
        yield length, np.flatnonzero(sizes == length)


def sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words to ``(length, counts)``."""
    for batch in batches:
        words = batch.column("word").to_pylist()
        for length, rows in length_groups(words):
            counts = vectors(letters_of([words[i] for i in rows.tolist()], length)).astype(np.uint8)
            lengths = pa.array(np.full(len(rows), length), pa.int32())
            yield pa.RecordBatch.from_arrays([lengths, pa.array([c.tobytes() for c in counts], pa.binary())], ["length", "counts"])


def cells_of(words: DataFrame) -> dict[int, Cells]:
    """The upper trees, from a sample by hash; lengths that the sample lacks are one cell each."""
    total = words.count()
    each = max(1.0, total / SAMPLE)
    if total <= CELL_WORDS:
        return {}
    space = 1 << 30
    taken = words.where(F.pmod(F.xxhash64("word"), F.lit(space)) < int(space / each))
    by_length: dict[int, list[bytes]] = {}
    for length, counts in taken.select("word").mapInArrow(sample_rows, "length int, counts binary").collect():
        by_length.setdefault(length, []).append(bytes(counts))
    return {
        length: Cells(np.frombuffer(b"".join(found), np.uint8).reshape(-1, DIMENSIONS).astype(np.int16), each)
        for length, found in by_length.items()
    }


POINT, SAME, SHORTER = 0, 1, 2


def dealt_rows(trees: dict[int, Cells], questions: dict[tuple[int, int], int]):
    """Words ``(word, n)`` to rows ``(length, cell, part, side, role, word, n)``.

    A cell of p parts of words and q of questions is searched in p * q groups: (part, side).
    """
    lone = Cells(np.zeros((0, DIMENSIONS), np.int16), 1.0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            spread = np.fromiter(map(zlib.crc32, words), np.int64, len(words))
            found: list[tuple[np.ndarray, ...]] = []

            def put(rows, length, cell, part, side, role):
                full = np.full(len(rows), 0)
                found.append((rows, full + length, full + cell, full + part, full + side, full + role))

            for length, rows in length_groups(words):
                counts = vectors(letters_of([words[i] for i in rows.tolist()], length))
                for target, role, reach in ((length, POINT, 0), (length, SAME, 2), (length + 1, SHORTER, 1)):
                    cells = trees.get(target, lone)
                    for cell, own in cells.dealt(counts, reach):
                        at = rows[own]
                        parts, sides = cells.parts[cell], questions.get((target, cell), 1)
                        if role == POINT:
                            for side in range(sides):
                                put(at, target, cell, spread[at] % parts, side, role)
                        else:
                            for part in range(parts):
                                put(at, target, cell, part, spread[at] % sides, role)
            for columns in found:
                rows, keys = columns[0], [pa.array(c, pa.int32()) for c in columns[1:]]
                own = [batch.column("word").take(pa.array(rows)), pa.array(n[rows], pa.int64())]
                yield pa.RecordBatch.from_arrays([*keys, *own], ["length", "cell", "part", "side", "role", "word", "n"])

    return each


def expected_questions(trees: dict[int, Cells]) -> dict[tuple[int, int], int]:
    """Into how many sides the questions of a cell are split, as its sample expects; only those of more than one."""
    seen: Counter[tuple[int, int]] = Counter()
    for length, own in trees.items():
        for target, reach in ((length, 2), (length + 1, 1)):
            if target in trees:
                for cell, rows in trees[target].dealt(own.sample, reach):
                    seen[target, cell] += len(rows) * own.each
            else:
                seen[target, 0] += len(own.sample) * own.each
    return {key: math.ceil(n / CELL_QUESTIONS) for key, n in seen.items() if n > CELL_QUESTIONS}


def searched(table: pa.Table) -> pa.Table:
    """One group of ``(length, cell, part, side)``: ``(word, n_near, best_n, best)`` of the words with near ones."""
    role = table.column("role").to_numpy()
    words = np.array(table.column("word").to_pylist(), object)
    n = table.column("n").to_numpy()
    # The place in this order: best first.
    place = np.empty(len(words), np.int64)
    place[np.array(sorted(range(len(words)), key=lambda i: (-n[i], words[i])), np.int64)] = np.arange(len(words))
    by_place = np.argsort(place)
    near, best = np.zeros(len(words), np.int64), np.full(len(words), len(words))
    points = np.flatnonzero(role == POINT)
    if len(points):
        letters = letters_of(list(words[points]), len(words[points[0]]))
        counts = vectors(letters)
        tree, signs = Tree(counts), signatures(counts)
        for kind in (SAME, SHORTER):
            rows = np.flatnonzero(role == kind)
            if not len(rows):
                continue
            asked = letters_of(list(words[rows]), len(words[rows[0]]))
            for i, j in near_pairs(asked, letters, tree, signs):
                i, j = rows[i], points[j]
                sides = ((i, j),) if kind == SAME else ((i, j), (j, i))
                for one, other in sides:
                    np.add.at(near, one, 1)
                    np.minimum.at(best, one, place[other])
    some = np.flatnonzero(near)
    chosen = by_place[best[some]]
    return pa.table(
        {
            "word": pa.array(words[some], pa.binary()), "n_near": pa.array(near[some], pa.int64()),
            "best_n": pa.array(n[chosen], pa.int64()), "best": pa.array(words[chosen], pa.binary()),
        }
    )


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n_near, best_n, best)`` for every word of ``words(word, n)`` with near words."""
    trees = cells_of(words)
    sides = expected_questions(trees)
    dealt = words.select("word", "n").mapInArrow(
        dealt_rows({length: cells.bare() for length, cells in trees.items()}, sides),
        "length int, cell int, part int, side int, role int, word binary, n long",
    )
    found = dealt.groupBy("length", "cell", "part", "side").applyInArrow(
        searched, "word binary, n_near long, best_n long, best binary"
    )
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("top")).select(
        "word", "n_near", (-F.col("top.less")).alias("best_n"), F.col("top.best").alias("best")
    )


def rounds(most: int) -> int:
    """Doublings of one link that reach the end of any chain of forms: n grows from MIN_COUNT by TIMES at each link."""
    links, n = 0, MIN_COUNT
    while n * TIMES <= most:
        links, n = links + 1, n * TIMES
    return max(0, links - 1).bit_length()


def variants(documents: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of the vocabulary."""
    words = staged(vocabulary(documents), "vocabulary")
    near = near_words(words)
    holds = F.col("best_n") >= TIMES * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(holds, F.col("best")).alias("form"), F.when(holds, F.col("best_n")).alias("form_n"),
    )
    formed = staged(joined, "forms")
    links = formed.where("form is not null").select("word", F.col("form").alias("to"))
    for _ in range(rounds(words.agg(F.max("n")).first()[0] or 0)):
        onward = links.select(F.col("word").alias("to"), F.col("to").alias("onward"))
        links = staged(
            links.join(onward, "to", "left").select("word", F.coalesce("onward", "to").alias("to")), "links"
        )
    rooted = formed.join(links, "word", "left")
    shown = {name: F.decode(F.col(name), "ISO-8859-1") for name in ("word", "form", "root")}
    return rooted.withColumn("root", F.coalesce("to", "word")).select(
        *(shown[name].alias(name) for name in shown), "n", "n_near", "form_n"
    )
