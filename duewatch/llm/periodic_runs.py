"""Periodic run detection by internal pattern matching.

Words of a batch of texts become one sequence of numbers, with a number of its own after each text. Prefix doubling
gives, for every power of two, the class of the words that follow a place; its last order is the suffix array. Every
text is cut into dyadic blocks of 8, 16, 32, ... words. A block of m words asks for its next occurrences in the
neighbouring window: a range successor on a wavelet tree over the suffix array. Occurrences that start within m places
of each other form one progression, so three questions a block suffice:

* one or two occurrences: their distances from the block are candidate periods;
* more: the difference p of the progression is the block's own period. A longer period must carry the ends of the
  block's stretch of period p to those of the progression's, so both pairs of ends give a candidate.

Blocks of m words find the periods from m to 2m-1, blocks of 8 also those below 8, since any run of at least
max(24, 3 * period) words contains an aligned block and its next copy. A candidate is extended both ways by the classes
and kept if it is long enough. Two candidates of the same stretch differ by a factor; the smallest is its period.

Whole texts are read, one text never spans tasks, and nothing is shuffled. A batch takes about 100 bytes a word, and a
text is never split, so a task needs that for its longest text. Null and empty texts have no words and no runs. A row
without ``doc_id`` is not rewritten. Repeated rows give equal results; extra columns are ignored; an empty table gives
an empty one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_WORDS = 24
MIN_TIMES = 3
#: The smallest dyadic block has 2 ** FIRST words: a third of MIN_WORDS, so that it finds all shorter periods.
FIRST = 3
#: Words of a batch of texts; only bounds memory.
BATCH_WORDS = 1 << 17
Run = tuple[int, int, int]


class Classes:
    """Classes of all stretches of 2 ** k words of a sequence, and its suffix array, by prefix doubling.

    Places whose stretch is the only one of its kind need no further sorting; from ``FIRST`` on only the others
    (``places``) are kept at all. ``levels[k]`` has the class of each place, equal for equal stretches.
    """

    def __init__(self, x: np.ndarray):
        n = len(x)
        order = np.argsort(x, kind="stable")
        head = np.ones(n, bool)
        head[1:] = x[order[1:]] != x[order[:-1]]
        rank = np.empty(n, np.int64)
        rank[order] = starts(head)
        open_ = order[~alone(head)]
        self.n, self.levels, k = n, [rank], 0
        self.places = self.number = None
        while k < FIRST or len(open_):
            if k == FIRST:
                self.places = np.sort(open_)
                self.number = np.full(n, -1, np.int64)
                self.number[self.places] = np.arange(len(self.places))
                self.levels[k] = rank[self.places]
            rank = rank.copy()
            if len(open_):
                old = rank[open_]
                key = old * n + rank[open_ + (1 << k)]
                by = np.argsort(key, kind="stable")
                open_, key = open_[by], key[by]
                old = old[by]  # unchanged: the key begins with it
                head = np.ones(len(open_), bool)
                head[1:] = key[1:] != key[:-1]
                group = np.ones(len(open_), bool)
                group[1:] = old[1:] != old[:-1]
                rank[open_] = old + starts(head) - starts(group)
                open_ = open_[~alone(head)]
            k += 1
            self.levels.append(rank if self.places is None else rank[self.places])
        if self.places is None:
            self.places, self.number = np.zeros(0, np.int64), np.full(n, -1, np.int64)
            self.levels[FIRST] = self.levels[FIRST][:0]
        self.last = len(self.levels) - 1
        self.order = np.argsort(self.levels[self.last], kind="stable")

    def equal(self, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the 2 ** k words from i equal those from j; places outside the sequence never do."""
        inside = (i >= 0) & (j >= 0) & (i < self.n) & (j < self.n)
        i, j = np.where(inside, i, 0), np.where(inside, j, 0)
        if k < FIRST:
            return inside & (self.levels[k][i] == self.levels[k][j])
        i, j = self.number[i], self.number[j]
        inside &= (i >= 0) & (j >= 0)
        if not len(self.places):
            return inside
        return inside & (self.levels[k][i] == self.levels[k][j])

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i equal those from j."""
        done = np.zeros(len(i), np.int64)
        for k in range(self.last, -1, -1):
            done += self.equal(k, i + done, j + done).astype(np.int64) << k
        return done

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before i equal those before j."""
        done = np.zeros(len(i), np.int64)
        for k in range(self.last, -1, -1):
            step = 1 << k
            done += self.equal(k, i - done - step, j - done - step).astype(np.int64) << k
        return done


def starts(head: np.ndarray) -> np.ndarray:
    """For each entry the index of the first entry of its group."""
    return np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))


def alone(head: np.ndarray) -> np.ndarray:
    """Whether an entry is the only one of its group."""
    return head & np.append(head[1:], True)


class WaveletTree:
    """Range successor over a permutation: the tree's levels as counts of zero bits, highest bit first."""

    def __init__(self, values: np.ndarray):
        self.bits = int(len(values)).bit_length()
        self.zeros: list[np.ndarray] = []
        for bit in range(self.bits - 1, -1, -1):
            one = (values >> bit) & 1
            total = np.zeros(len(values) + 1, np.int64)
            np.cumsum(1 - one, out=total[1:])
            self.zeros.append(total)
            one = one.astype(bool)
            values = np.concatenate([values[~one], values[one]])

    def successor(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The smallest value of at least ``least`` among entries low to high-1; -1 without one."""
        a, b, smaller = low, high, np.zeros(len(low), np.int64)
        for depth, total in enumerate(self.zeros):
            one = ((least >> (self.bits - 1 - depth)) & 1).astype(bool)
            za, zb = total[a], total[b]
            smaller += np.where(one, zb - za, 0)
            a = np.where(one, total[-1] + a - za, za)
            b = np.where(one, total[-1] + b - zb, zb)
        found = smaller < high - low
        a, b, left = low[found], high[found], smaller[found]
        value = np.zeros(len(a), np.int64)
        for total in self.zeros:
            za, zb = total[a], total[b]
            one = left >= zb - za
            left = np.where(one, left - (zb - za), left)
            a = np.where(one, total[-1] + a - za, za)
            b = np.where(one, total[-1] + b - zb, zb)
            value = 2 * value + one
        out = np.full(len(low), -1, np.int64)
        out[found] = value
        return out


def candidates(classes: Classes, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, period)``: places of blocks and the periods that their next occurrences suggest."""
    nothing = np.zeros(0, np.int64)
    if not len(classes.places):
        return nothing, nothing
    tree = WaveletTree(classes.order)
    text = np.searchsorted(begins, classes.places, "right") - 1
    offset, room = classes.places - begins[text], ends[text] - classes.places
    asked = []
    for k in range(FIRST, classes.last + 1):
        m = 1 << k
        ranks = classes.levels[k][classes.order]
        block = np.flatnonzero((offset % m == 0) & (room >= m))
        own = classes.levels[k][block]
        low, high = np.searchsorted(ranks, own), np.searchsorted(ranks, own, "right")
        some = high > low + 1
        place, low, high = classes.places[block[some]], low[some], high[some]
        asked.append((place, low, high, place + m, place + 2 * m))
        if k == FIRST:
            near = (place, low, high, place + 1, place + m)
    found = []

    def following(question, after=None):
        """The next occurrence in the window, and the questions and occurrences where there is one."""
        place, low, high, since, until = question
        at = tree.successor(low, high, np.searchsorted(classes.places, since if after is None else after + 1))
        seen = np.where(at >= 0, classes.places[at], until)
        some = seen < until
        return tuple(part[some] for part in question), seen[some], some

    question, first, _ = following(near)
    found.append((question[0], first - question[0]))
    question, first, _ = following(tuple(np.concatenate(parts) for parts in zip(*asked, strict=True)))
    found.append((question[0], first - question[0]))
    question, second, some = following(question, first)
    first = first[some]
    found.append((question[0], second - question[0]))
    question, _, some = following(question, second)
    place, first, step = question[0], first[some], (second - first)[some]
    right = classes.ahead(first, first + step) + first - classes.ahead(place, place + step) - place
    left = first - classes.behind(first, first + step) - place + classes.behind(place, place + step)
    found += [(place, right), (place, left)]
    place, period = (np.concatenate(parts) for parts in zip(*found, strict=True))
    return place[period > 0], period[period > 0]


def runs_of(texts: list[np.ndarray]) -> list[list[Run]]:
    """The runs ``(start, length, period)`` of each sequence of numbers, by start, then period."""
    out: list[list[Run]] = [[] for _ in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    if not (sizes >= MIN_WORDS).any():
        return out
    # A number of its own stands before the first text and after every text; texts share no numbers.
    begins = np.cumsum(sizes + 1) - sizes
    ends = begins + sizes
    x = np.empty(int(ends[-1]) + 1, np.int64)
    x[0] = 0
    free = 1
    for begin, end, words in zip(begins.tolist(), ends.tolist(), texts, strict=True):
        x[begin:end] = words + free
        free += int(words.max()) + 1 if len(words) else 0
        x[end] = free
        free += 1
    classes = Classes(x)
    place, period = candidates(classes, begins, ends)
    start = place - classes.behind(place, place + period)
    end = place + period + classes.ahead(place, place + period)
    long = end - start >= np.maximum(MIN_WORDS, MIN_TIMES * period)
    start, end, period = start[long], end[long], period[long]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    text = np.searchsorted(begins, start, "right") - 1
    for i in order.tolist():
        t = int(text[i])
        out[t].append((int(start[i] - begins[t]), int(end[i] - start[i]), int(period[i])))
    return out


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    number = {word: i for i, word in enumerate(set(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, with the tail of one document in ten made periodic as its id's checksum says."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Without the words that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def strongest(runs: list[Run]) -> Run | None:
    """The run with the greatest length by period; of equal ones the first, then that of the smallest period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def described(runs: list[Run], words: list[bytes]) -> tuple:
    best = strongest(runs)
    listed = "".join(f"{start},{length},{period}\n" for start, length, period in runs)
    kept = collapsed(words, runs)
    return (
        len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(),
        len(words), len(words) - len(kept),
    )


FIELDS = (
    ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
    ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
    ("n_words", pa.int64()), ("n_dropped", pa.int64()),
)


def run_rows(rewrite: bool):
    """Rows of ``(doc_id, text)`` to rows of ``(doc_id, <FIELDS>)``, some texts at a time."""

    def table(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
        found = runs_of([numbered(words) for words in texts])
        rows = [described(runs, words) for runs, words in zip(found, texts, strict=True)]
        columns = zip(*rows, strict=True)
        arrays = [pa.array(column, kind) for column, (_, kind) in zip(columns, FIELDS, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *arrays], ["doc_id", *(n for n, _ in FIELDS)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                if rewrite:
                    words = planted(i, words)
                ids.append(i)
                texts.append(words)
                held += len(words)
                if held >= BATCH_WORDS:
                    yield table(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield table(ids, texts)

    return each


def periodic_runs(documents: DataFrame, rewrite: bool = False) -> DataFrame:
    """``(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, n_words, n_dropped)``.

    ``rewrite`` first makes the tail of one document in ten periodic (:func:`planted`).
    """
    kinds = {"int64": "long", "string": "string"}
    schema = "doc_id long, " + ", ".join(f"{name} {kinds[str(kind)]}" for name, kind in FIELDS)
    rows = documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run_rows(rewrite), schema)
