"""Language-model scoring by online logistic context mixing.

A text is its lower-cased words, each closed by a space, and one end mark. Its bytes are read bit by bit, in prefix codes
made from the frequencies of bytes after each byte in the training words, so that a byte takes three or four decisions.
For each bit

* four predictors give the log odds of a one. Three hold counts of the whole training corpus: the last two and the last
  four bytes of the word, hashed into tables of fixed size, and the whole word so far, exact, in a table that grows with the
  corpus. One learns while it reads: the word so far, hashed into a small table of bounded counts;
* a gate, how often the corpus has the word so far, picks the weights that add up the first three, so this sum is the same
  wherever a word stands. The gate and whether the text had the word so far before pick the weights that add the
  fourth to it; these move along the gradient of the coding cost while a text is read;
* an adaptive map of the mixed log odds refines the probability, and learns from the bits too.

The sum of the bits' costs is the cost of the text, and its score is minus that, as log10 of the probability. The weights'
starting points come from all training words: every count less one, as an unread text would meet it, summed into a
bounded grid of cells. What is learned while reading moves after every bit and is kept to the end of the text. Texts start
anew and are read side by side, so no text depends on another one's place; the bits from ``LONG`` on, where fewer than ``FEW``
texts are as long, are read one text at a time, by the same rule in double precision.

On Spark: tasks turn texts into numbers and write them with the words of each block (some ``BLOCK_BYTES`` of text). Words are
counted over all blocks and dealt by range in the order of their codes, so that all words that share bits lie side
by side; each range sums the counts of every shared beginning, and adds what beginnings at its two ends have in the other
ranges (one row for each range passes the driver). Each block then gets its own words' predictions by a join, packed into
few rows, and scores its texts. No task holds more than a block or a range.

Training texts are those whose ``crc32`` of the id has a remainder other than 0 by ``FOLDS``. Null and empty texts have the end
mark only. Rows without ``doc_id`` are not learned from and count as held out. Repeated rows are learned from as often as
they occur and score the same; extra columns are ignored. Empty tables give an empty result; without training texts every
word is unknown. Words keep their own predictor for their first ``KNOWN_BYTES`` bytes; all later bytes are scored by the others.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Generator, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import work_folder
from .shingles import mix, powers

FOLDS = 10
SPACE, END = b" ", b"\n"
#: Text of a block and words of a range; they bound the memory of a task.
BLOCK_BYTES, RANGE_WORDS = 32 << 20, 50_000
#: Log2 of the slots of the two hashed tables of the corpus, and of a stretch's own one.
SLOTS2, SLOTS4, OWN_SLOTS = 16, 20, 13
KNOWN_BYTES = 24
#: Bits of a text that are read as one; no text is longer than that.
STRETCH = 1 << 40
#: Bits of a stretch that are read before its weights, its own table and its map move.
STEPS = 1
#: Stretches read side by side, bits gathered and read at a time, and words spelled at a time; only bound memory.
LANES, GATHERED, PREPARED, SPELL = 2000, 1 << 20, 1 << 18, 1 << 13
#: From this bit on a stretch is read by itself where fewer than ``FEW`` are as long.
LONG, FEW = 1 << 16, 16
#: Log odds are held as whole numbers of this unit.
UNIT = 0.1
#: Those of a word's own table take five bits: a sign and one of these sizes. The gate takes the other three of a byte.
SIZES = np.array([0, 0.2, 0.5, 0.8, 1.2, 1.6, 2.1, 2.7, 3.4, 4.2, 5.1, 6.1, 7.2, 8.5, 10, 12])
GATES = 8
#: Starting weight of the predictor that learns while reading, rates of the weights and of the adaptive map.
OWN_WEIGHT, RATE, MAP_RATE = 0.25, 0.02, 0.02
#: Half the number of columns of the adaptive map by log odds, and columns for each.
MAP_HALF, MAP_STEP = 8, 4
#: Log odds are cut here when summed up for the starting weights; a cell is one gate and three such numbers.
CELL_HALF = 12
MOST_ODDS = 12.0


#: A multiplier, and a number for each node of the code.
ODD = np.uint64(0x9E3779B97F4A7C15)
NODES = mix(np.arange(256, dtype=np.uint64) + ODD)


# --- the code of bytes


class Code:
    """A prefix code for bytes after each byte.

    ``length`` and ``first`` are by 256 * (byte before) + byte: the decisions for the byte, and where its ``bit`` and
    ``node`` begin. ``rank`` orders bytes by their codes.
    """

    def __init__(self, counts: np.ndarray):
        """Codes of least length for the counts of pairs; each byte counts at least once."""
        self.length, self.rank = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.uint8)
        bits, nodes = [], []
        plain = None
        for before in range(256):
            own = counts[256 * before : 256 * before + 256]
            if own.any():
                paths = shortest(own)
            else:
                paths = plain = plain or shortest(own)
            for place, (byte, path) in enumerate(paths.items()):  # in the order of their codes
                self.rank[256 * before + byte] = place
            for byte in range(256):
                self.length[256 * before + byte] = len(paths[byte])
                nodes += [node for node, _ in paths[byte]]
                bits += [bit for _, bit in paths[byte]]
        self.first = (np.cumsum(self.length) - self.length).astype(np.int32)
        self.bit, self.node = np.array(bits, np.uint8), np.array(nodes, np.uint8)

    def keys(self, words: list[bytes]) -> list[bytes]:
        """Bytes that sort as the words' bits do."""
        return self.places(words).to_pylist()

    def places(self, words: pa.Array | list[bytes]) -> pa.Array:
        """The same as an array."""
        data, ends = joined(words)
        order = pa.py_buffer(self.rank.take(pairs(data, ends)).tobytes())
        starts = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes())
        return pa.Array.from_buffers(pa.binary(), len(ends), [None, starts, order])


def shortest(counts: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """For each byte, in the order of the codes, the nodes and bits on its way down the tree."""
    heap = [(int(n) + 1, byte, byte) for byte, n in enumerate(counts)]
    heapq.heapify(heap)
    fresh = 256
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], fresh, (a[2], b[2])))
        fresh += 1
    paths: dict[int, list[tuple[int, int]]] = {}
    todo, inner = [(heap[0][2], [])], 0
    while todo:  # zeros first
        at, path = todo.pop()
        if isinstance(at, int):
            paths[at] = path
        else:
            todo += [(at[1], [*path, (inner, 1)]), (at[0], [*path, (inner, 0)])]
            inner += 1
    return paths


def closed(word: bytes) -> bytes:
    return word if word == END else word + SPACE


def bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values of a binary array without nulls, and each value's size."""
    _, starts, data = values.buffers()
    if not len(values) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(values), np.int64)
    starts = np.frombuffer(starts, np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], np.diff(starts).astype(np.int64)


def joined(words: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, closed, and each word's end in them."""
    data, sizes = bytes_of(words if isinstance(words, pa.Array) else pa.array(words, pa.binary()))
    sizes[(sizes != 1) | (data.take(np.cumsum(sizes) - 1) != END[0])] += 1
    ends = np.cumsum(sizes)
    whole = np.full(sizes.sum(), SPACE[0], np.uint8)
    inner = np.ones(len(whole), bool)
    inner[ends[(sizes != 1)] - 1] = False
    whole[inner] = data
    return whole, ends


def pairs(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """256 * (byte before) + byte; before a word stands a space."""
    out = data.astype(np.int32)
    out[1:] += 256 * data[:-1].astype(np.int32)
    first = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
    out[first] = data[first].astype(np.int32) + 256 * SPACE[0]
    return out


class Spelled:
    """The bits of many words, one after the other, and the contexts they are predicted from."""

    def __init__(self, words: pa.Array | list[bytes], code: Code):
        self.data, ends = joined(words)
        #: Bytes, bits, and bits that the word's own table knows, of each word; ``begin``: its first bit.
        self.bytes = np.diff(ends, prepend=0)
        self.start = ends - self.bytes
        self.place = np.arange(len(self.data)) - np.repeat(self.start, self.bytes)
        pair = pairs(self.data, ends)
        long = code.length[pair]
        known = np.where(self.place < KNOWN_BYTES, long, 0)
        self.sizes, self.known = (np.add.reduceat(x, self.start) if len(words) else x for x in (long, known))
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.byte = np.repeat(np.arange(len(self.data), dtype=np.int32), long)
        shift = code.first[pair] - (np.cumsum(long) - long).astype(np.int32)
        step = np.arange(len(self.byte), dtype=np.int32) + shift[self.byte]
        self.bit = code.bit.take(step)
        self.node = NODES.take(code.node.take(step))

    def _hashed(self, context: np.ndarray, bits: int) -> np.ndarray:
        """A number of so many bits from the context of a bit's byte and the node of the code."""
        mixed = mix(context).take(self.byte)
        mixed ^= self.node
        mixed *= ODD
        mixed >>= np.uint64(64 - bits)
        return mixed

    def slots(self) -> tuple[np.ndarray, np.ndarray]:
        """Places in the tables of the last two and the last four bytes."""
        back = np.full((4, len(self.data)), 0x100, np.uint64)
        for k in range(4):
            inside = np.flatnonzero(self.place > k)
            back[k, inside] = self.data[inside - k - 1]
        two = back[0] * np.uint64(0x200) + back[1]
        four = (two * np.uint64(0x200) + back[2]) * np.uint64(0x200) + back[3]
        return self._hashed(two, SLOTS2).astype(np.int32), self._hashed(~four, SLOTS4).astype(np.int32)

    def beginnings(self) -> np.ndarray:
        """A number of 32 bits for all bits of the word before each bit."""
        up, down = powers(len(self.data))
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=total[1:])
        start = np.repeat(self.start, self.bytes)
        return self._hashed((total[:-1] - total[start]) * down[start] + self.place.astype(np.uint64), 32).astype(np.uint32)


def odds(ones: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """Log odds of counts in whole units."""
    x = np.log((ones + 0.4) / (zeros + 0.4)) / UNIT
    return np.clip(np.rint(x), -MOST_ODDS / UNIT, MOST_ODDS / UNIT).astype(np.int8)


def gate_of(seen: np.ndarray) -> np.ndarray:
    """Half the number of bits of the count, at most 7; 0 only for 0."""
    return np.minimum((np.frexp(seen.astype(np.float64))[1] + 1) // 2, GATES - 1).astype(np.uint8)


def own_byte(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Gate and log odds of the bit that comes, where ``before`` words share what precedes it and ``after`` also it."""
    place = np.minimum(before, SMALL - 1)
    place *= SMALL
    place += np.minimum(after, SMALL - 1)
    out = OWN_SMALL.take(place, mode="clip")
    large = np.flatnonzero((before >= SMALL) | (before < 0))
    out[large] = own_byte_of(before[large], after[large])
    return out


def own_byte_of(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The same for each pair by itself."""
    x = np.log((after + 0.4) / (before - after + 0.4))
    size = np.searchsorted((SIZES[1:] + SIZES[:-1]) / 2, np.abs(x)).astype(np.uint8)
    size[before == 0] = 0
    return (gate_of(before) << 5) | ((x < 0).astype(np.uint8) << 4) | size


#: Such bytes by SMALL * before + after.
SMALL = 128
OWN_SMALL = own_byte_of(
    np.repeat(np.arange(SMALL), SMALL), np.minimum(np.tile(np.arange(SMALL), SMALL), np.repeat(np.arange(SMALL), SMALL))
)
#: Log odds by the low five bits of such a byte, in units.
OWN_ODDS = np.rint(np.concatenate([SIZES, -SIZES]) / UNIT).astype(np.int8)


# --- words and blocks


TEXT, WORD = 0, 1
READ = "kind int, block long, doc_id long, held_out boolean, number int, word binary, n long, body binary"
READ_NAMES = [part.split()[0] for part in READ.split(", ")]


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def packed_numbers(numbers: np.ndarray) -> bytes:
    """Low bytes first, then the next ones, compressed: the high bytes are nearly all zero."""
    return zstandard.compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpacked_numbers(body: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(body), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int32)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    words, many = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    some = pc.not_equal(pc.binary_length(words), 0)  # a blank text leaves an empty word
    if pc.all(some).as_py() is not False:
        return words, many
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    return words.filter(some), np.diff(before[np.cumsum(many)], prepend=0)


def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``(doc_id, text)`` to numbered texts and the words of each block with their training counts."""
    task = TaskContext.get()
    block = (task.partitionId() if task else 0) << 24
    ids, words, sizes, held = [], [], [], 0

    def flushed() -> Iterator[pa.RecordBatch]:
        coded = pa.chunked_array(words).combine_chunks().dictionary_encode()
        found = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
        many = np.concatenate(sizes)
        stop = np.cumsum(many + 1)  # each text closes with the end
        numbers = np.full(stop[-1], len(found) - 1, np.int32)
        inner = np.ones(len(numbers), bool)
        inner[stop - 1] = False
        numbers[inner] = coded.indices.to_numpy()
        out = np.fromiter(map(is_held_out, ids), bool, len(ids))
        n = np.bincount(numbers[np.repeat(~out, many + 1)], minlength=len(found))
        order = np.argsort(-np.bincount(numbers, minlength=len(found)), kind="stable")
        place = np.empty(len(found), np.int32)  # frequent words get small numbers
        place[order] = np.arange(len(found))
        numbers = place.take(numbers)
        bodies = [packed_numbers(numbers[a:b]) for a, b in zip([0, *stop.tolist()], stop.tolist(), strict=False)]
        for low in range(0, len(ids), 512):
            some = slice(low, low + 512)
            yield record(
                len(ids[some]), kind=TEXT, block=block, doc_id=ids[some], held_out=out[some], body=bodies[some]
            )
        for low in range(0, len(found), 1 << 16):
            some = order[low : low + (1 << 16)]
            yield record(
                len(some), kind=WORD, block=block, number=range(low, low + len(some)),
                word=found.take(pa.array(some)), n=n[some],
            )

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
        low, before = 0, 0
        while low < len(batch):  # a block ends with the text that fills it
            high = min(len(batch), int(np.searchsorted(ends, before + BLOCK_BYTES - held)) + 1)
            part = batch.slice(low, high - low)
            ids += part.column("doc_id").to_pylist()
            some, many = words_of(part.column("text"))
            words.append(some)
            sizes.append(many)
            held += int(ends[high - 1]) - before
            low, before = high, int(ends[high - 1])
            if held >= BLOCK_BYTES:
                yield from flushed()
                block += 1
                ids, words, sizes, held = [], [], [], 0
    if ids:
        yield from flushed()


READ_TYPES = dict(
    zip(READ_NAMES, (pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary(), pa.int64(), pa.binary()), strict=True)
)


def record(rows: int, **columns) -> pa.RecordBatch:
    """A batch with some columns given, as one value or one for each row, and nulls in the others."""
    arrays = []
    for name, kind in READ_TYPES.items():
        value = columns.get(name)
        if value is None:
            value = pa.nulls(rows, kind)
        elif isinstance(value, int):
            value = pa.repeat(pa.scalar(value, kind), rows)
        arrays.append(value if isinstance(value, pa.Array) else pa.array(value, kind))
    return pa.RecordBatch.from_arrays(arrays, READ_NAMES)


def histogram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words to training counts of their pairs of bytes."""
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        n = batch.column("n").to_numpy()
        data, ends = joined(batch.filter(pa.array(n > 0)).column("word"))
        if len(ends):
            np.add.at(total, pairs(data, ends), np.repeat(n[n > 0], np.diff(ends, prepend=0)))
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["pair", "n"])


def slot_rows(code: Code):
    """Words to the training counts of zeros and ones in the slots of both hashed tables."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = (1 << SLOTS2) + (1 << SLOTS4)
        total = np.zeros(2 * slots, np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            own = Spelled(batch.filter(pa.array(n > 0)).column("word"), code)
            n = np.repeat(n[n > 0], own.sizes)
            slot2, slot4 = own.slots()
            np.add.at(total, 2 * slot2 + own.bit, n)
            np.add.at(total, 2 * (slot4 + (1 << SLOTS2)) + own.bit, n)
        pairs = total.reshape(-1, 2)
        some = np.flatnonzero(pairs.any(axis=1))
        columns = [pa.array(some, pa.int32()), pa.array(pairs[some, 0]), pa.array(pairs[some, 1])]
        yield pa.RecordBatch.from_arrays(columns, ["slot", "zeros", "ones"])

    return each


# --- counts of shared beginnings


class Beginnings:
    """For words in the order of their codes: the training counts of all words with the same first bits.

    ``before[i]`` counts the words that share the bits before bit i, ``after[i]`` those that share bit i too. ``left`` and
    ``right`` hold, for each number of bits, what other ranges have that share so many with the first and the last word.
    """

    def __init__(self, own: Spelled, n: np.ndarray, left: np.ndarray, right: np.ndarray):
        self.before, self.after = np.zeros(len(own.bit), np.int64), np.zeros(len(own.bit), np.int64)
        self.first, self.last = [int(n.sum())], [int(n.sum())]
        rows = np.arange(len(n))
        total = np.full(len(n), n.sum() + at(left, 0) + at(right, 0))
        segment = np.zeros(len(n), np.int64)
        level = 0
        while True:
            stay = own.known[rows] > level
            rows, segment, total = rows[stay], segment[stay], total[stay]
            if not len(rows):
                break
            place = own.begin[rows] + level
            self.before[place] = total
            bit = own.bit[place]
            head = np.ones(len(rows), bool)
            head[1:] = (segment[1:] != segment[:-1]) | (bit[1:] != bit[:-1])
            sums = np.add.reduceat(n[rows], np.flatnonzero(head))
            level += 1
            if rows[0] == 0:
                self.first.append(int(sums[0]))
                sums[0] += at(left, level)
            if rows[-1] == len(n) - 1:
                self.last.append(int(sums[-1]))
                sums[-1] += at(right, level)
            segment = np.cumsum(head) - 1
            total = sums[segment]
            self.after[place] = total


def at(values: np.ndarray, i: int) -> int:
    return int(values[i]) if i < len(values) else 0


def shared(a: bytes, b: bytes) -> int:
    """How many of the first bits agree; one byte a bit."""
    both = min(len(a), len(b))
    x, y = np.frombuffer(a[:both], np.uint8), np.frombuffer(b[:both], np.uint8)
    differ = np.flatnonzero(x != y)
    return int(differ[0]) if len(differ) else both


def outside(ranges: list) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """What the other ranges add to the shared beginnings of each range's first and last word.

    ``ranges``: rows ``(range, first, last, first_sums, last_sums)`` in the order of the words.
    """
    left, right = {}, {}
    for order, into, near, far, sums in ((ranges, left, 1, 2, 4), (ranges[::-1], right, 2, 1, 3)):
        past, carried = None, np.zeros(0, np.int64)
        for row in order:
            if past is None:
                carried = np.zeros(0, np.int64)
            else:
                border = shared(bytes(past[far]), bytes(row[near]))
                own = np.array(past[sums], np.int64)[: border + 1]
                through = shared(bytes(past[1]), bytes(past[2]))
                more = carried[: min(border, through) + 1]
                own[: len(more)] += more[: len(own)]
                carried = own
            into[row[0]] = carried
            past = row
    return {key: (left[key], right[key]) for key in left}


def in_order(table: pa.Table, code: Code) -> tuple[pa.Array, np.ndarray]:
    """A range's words in the order of their codes, with their counts."""
    words, n = pa.concat_arrays(table.column("word").chunks), table.column("n").to_numpy()
    order = pc.array_sort_indices(code.places(words))
    return words.take(order), n[order.to_numpy()]


def sums_beside(words: pa.Array, n: np.ndarray, edge: int, code: Code) -> tuple[bytes, list[int]]:
    """The known bits of one word, and for each number of them the count of all words that share so many.

    These are the ``first`` or ``last`` sums of ``Beginnings``, without those of all other beginnings.
    """
    own = Spelled(words.slice(edge, 1), code)
    bits, mine = own.bit[: own.known[0]].tobytes(), own.data[:KNOWN_BYTES]
    data, ends = joined(words)
    place = np.diff(ends, prepend=0)
    place = np.minimum((ends - place)[:, None] + np.arange(len(mine)), len(data) - 1)
    other = data.take(place)  # behind a word's end nothing is asked: its closing differs, or it is the same word
    agree = (other == mine).cumprod(axis=1, dtype=np.uint8).sum(axis=1)
    before = np.concatenate([[SPACE[0]], mine[:-1]]).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(code.length[256 * before + mine])])
    level = begin[agree]
    part = np.flatnonzero(agree < len(mine))  # bits of the first byte that differs
    pair, found = np.unique(256 * agree[part] + other[part, agree[part]], return_inverse=True)
    more = []
    for at, byte in zip((pair >> 8).tolist(), (pair & 255).tolist(), strict=True):
        first, size = code.first[256 * before[at] + byte], code.length[256 * before[at] + byte]
        more.append(shared(code.bit[first : first + size].tobytes(), bits[begin[at] : begin[at + 1]]))
    level[part] += np.array(more, np.int64)[found]
    sums = np.zeros(len(bits) + 1, np.int64)
    np.add.at(sums, level, n)
    return bits, np.cumsum(sums[::-1])[::-1].tolist()


def border_rows(code: Code):
    """A range to one row: its first and last word's known bits, and the counts of their beginnings."""

    def each(key: tuple, table: pa.Table) -> pa.Table:
        words, n = in_order(table, code)
        (first, first_sums), (last, last_sums) = (sums_beside(words, n, edge, code) for edge in (0, len(words) - 1))
        return pa.table(
            {
                "range": pa.array([key[0].as_py()], pa.int32()), "first": pa.array([first], pa.binary()),
                "last": pa.array([last], pa.binary()), "first_sums": [first_sums], "last_sums": [last_sums],
            }
        )

    return each


def own_predictions(own: Spelled, n: np.ndarray, sums: Beginnings) -> list[bytes]:
    """For each word the bytes of its bits, up to where no other word shares its beginning."""
    alone = sums.before == np.repeat(n, own.sizes)
    alone |= np.arange(len(alone)) - np.repeat(own.begin, own.sizes) >= np.repeat(own.known, own.sizes)
    place = np.where(alone, np.arange(len(alone)), len(alone))
    stop = np.minimum(np.minimum.reduceat(place, own.begin), own.begin + own.sizes)
    found = own_byte(sums.before, sums.after).tobytes()
    return [found[a:b] for a, b in zip(own.begin.tolist(), stop.tolist(), strict=True)]


def cells_of_fit(own: Spelled, n: np.ndarray, sums: Beginnings, tables: tuple[np.ndarray, np.ndarray]):
    """Sums by (gate, three rounded log odds of the bit that came), each count less one for the word itself."""
    some = (np.repeat(n, own.sizes) > 0) & (sums.before > 0)
    found = own_byte(sums.before[some] - 1, sums.after[some] - 1)
    sign = 2 * own.bit[some].astype(np.int8) - 1
    cell = (found >> 5).astype(np.int64)
    near = np.rint(np.arange(256, dtype=np.uint8).view(np.int8) * UNIT)  # by such odds, as a byte
    near = (np.clip(near, -CELL_HALF, CELL_HALF) + CELL_HALF).astype(np.int64)
    slot2, slot4 = own.slots()
    for value in (tables[0].take(slot2[some]) * sign, tables[1].take(slot4[some]) * sign, OWN_ODDS.take(found & 31)):
        cell *= 2 * CELL_HALF + 1
        cell += near.take(value.view(np.uint8))
    total = np.bincount(cell, np.repeat(n, own.sizes)[some])  # exact: whole numbers far below 2 ** 53
    found = np.flatnonzero(total)
    return found, total[found].astype(np.int64)


KNOWN = "kind int, word binary, n long, body binary, cell int"


def known_rows(code: Code, tables: tuple[np.ndarray, np.ndarray], borders: dict):
    """A range to the predictions of its words, and to its sums for the starting weights."""

    def each(key: tuple, table: pa.Table) -> pa.Table:
        words, n = in_order(table, code)
        own = Spelled(words, code)
        sums = Beginnings(own, n, *borders[key[0].as_py()])
        found, weight = cells_of_fit(own, n, sums, tables)
        full, more = len(words), len(found)
        return pa.table(
            {
                "kind": pa.array([WORD] * full + [TEXT] * more, pa.int32()),
                "word": pa.concat_arrays([words, pa.nulls(more, pa.binary())]),
                "n": pa.array(np.concatenate([n, weight]), pa.int64()),
                "body": pa.array(own_predictions(own, n, sums) + [None] * more, pa.binary()),
                "cell": pa.array([None] * full + found.tolist(), pa.int32()),
            }
        )

    return each


def starting_weights(cells: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of the three predictors of the corpus for each gate, by Newton steps on the summed cells."""
    side = 2 * CELL_HALF + 1
    parts = []
    for _ in range(3):
        parts.append(cells % side - CELL_HALF)
        cells = cells // side
    x = np.stack(parts[::-1], axis=1).astype(np.float64)
    out = np.full((GATES, 3), 0.3)
    for gate in range(GATES):
        own, m = x[cells == gate], weight[cells == gate].astype(np.float64)
        for _ in range(12 if len(own) else 0):
            p = 1 / (1 + np.exp(-np.clip(own @ out[gate], -30, 30)))
            slope = own.T @ (m * (1 - p)) - 0.01 * m.sum() * (out[gate] - 0.3)
            bend = (own * (m * p * (1 - p))[:, None]).T @ own + 0.01 * m.sum() * np.eye(3)
            step = np.linalg.solve(bend, slope)
            out[gate] += step / max(1.0, np.abs(step).max())
    return out


# --- reading


def next_states() -> tuple[np.ndarray, np.ndarray]:
    """By 2 * state + bit: the next state, and the log odds of that bit. A state is (zeros, ones), each up to 7."""
    after, value = np.zeros(128, np.uint8), np.zeros(128, np.float32)
    for zeros in range(8):
        for ones in range(8):
            for bit in (0, 1):
                counts = [zeros, ones]
                key = 2 * (8 * zeros + ones) + bit
                value[key] = math.log((counts[bit] + 0.4) / (counts[1 - bit] + 0.4))
                counts[bit] = min(7, counts[bit] + 1)
                if counts[1 - bit] > 2:
                    counts[1 - bit] = counts[1 - bit] // 2 + 1
                after[key] = 8 * counts[0] + counts[1]
    return after, value


AFTER, VALUE = next_states()
#: Lanes hold 2 * state, and lie so far from each other that their equal slots don't share lines of a cache.
AFTER_TWICE = AFTER << 1
SPAN = (1 << OWN_SLOTS) + 64


class Lanes:
    """Stretches of bits read side by side; each learns after each of its bits."""

    def __init__(self, lanes: int):
        cells = lanes * GATES * 2
        #: By (lane, gate, met before): weights of the corpus's log odds, and of the text's own as the imaginary part, as both
        #: are always looked up together.
        self.weights = np.full(cells, 1 + 1j * OWN_WEIGHT, np.complex64)
        self.columns = 2 * MAP_HALF * MAP_STEP + 1
        line = 1 / (1 + np.exp(-(np.arange(self.columns) / MAP_STEP - MAP_HALF)))
        #: By (lane, gate, column).
        self.map = np.tile(line.astype(np.float32), lanes * GATES)
        self.states = np.zeros(lanes * SPAN, np.uint8)
        self.lane = np.arange(lanes)

    def read(self, odds_in: np.ndarray, bit: np.ndarray, gate: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Probabilities of the bits that came, by (lane, step), as all other arrays.

        ``odds_in`` are the corpus's log odds of the bit that came.
        """
        full = np.full(bit.shape[1], len(bit))
        return self.steps(odds_in.T.astype(np.float32), bit.T.copy(), gate.T.astype(np.uint8), slot.T, full).T

    def steps(self, odds_in: np.ndarray, bit: np.ndarray, gate: np.ndarray, slot: np.ndarray, active: np.ndarray) -> np.ndarray:
        """As ``read``, by (step, lane). Only the first ``active`` lanes have a bit at a step; others get 1.

        What a place holds depends on the bits alone, the weights on the places too, and the map on the mixed log odds. So the
        three are followed one after the other. Lanes without a bit go on with zeros: they are not asked any more.
        """
        lane = self.lane[: bit.shape[1]]
        key = self._keys(slot + lane * SPAN, bit)
        place = gate << np.uint8(1)
        place |= key > 1
        cell = place.astype(np.intp)
        cell += lane * (2 * GATES)
        ones = bit.astype(np.float32)
        half = ones - np.float32(0.5)
        mixed, moved = self._mixed(cell, odds_in, VALUE.take(key))
        mixed *= half
        mixed *= np.float32(2 * MAP_STEP)
        mixed += np.float32(MAP_STEP * MAP_HALF + 0.5)
        np.maximum(mixed, 0, out=mixed)
        np.minimum(mixed, np.float32(self.columns - 0.5), out=mixed)
        column = gate.astype(np.uint16)
        column *= np.uint16(self.columns)
        column += mixed.astype(np.uint16)
        np.add(column, lane * (GATES * self.columns), out=cell)
        ones *= np.float32(MAP_RATE)
        refined = self._shares(cell, ones, mixed)
        refined -= np.float32(0.5)
        refined *= half
        moved *= np.float32(-0.5 / RATE)
        moved += refined
        moved += np.float32(0.75)
        if active[-1] < len(lane):
            moved[np.arange(len(lane)) >= active[:, None]] = 1
        return moved

    def _keys(self, slot: np.ndarray, bit: np.ndarray) -> np.ndarray:
        """2 * (state of the bit's place) + bit; places learn."""
        states, follow, both = self.states, AFTER_TWICE.take, np.bitwise_or
        out = np.empty(bit.shape, np.uint8)
        for at, one, key in zip(slot, bit, out, strict=True):
            states.take(at, out=key, mode="clip")
            both(key, one, key)
            states[at] = follow(key)
        return out

    def _mixed(self, cell: np.ndarray, given: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mixed log odds of the bit that came, and the rate times their error; weights learn. Takes the other arrays."""
        weights = self.weights
        low, high, rate, one = np.float32(-MOST_ODDS), np.float32(MOST_ODDS), np.float32(RATE), np.float32(1)
        add, multiply, divide, exp, least, most = np.add, np.multiply, np.divide, np.exp, np.minimum, np.maximum
        mixed, moved = np.empty(given.shape, np.float32), np.empty(given.shape, np.float32)
        both = np.empty(given.shape[1], np.complex64)
        weight, mine = both.real, both.imag
        for at, x, y, z, error in zip(cell, given, value, mixed, moved, strict=True):
            weights.take(at, out=both, mode="clip")
            multiply(weight, x, z)
            multiply(mine, y, error)
            add(z, error, z)
            least(z, high, z)
            most(z, low, z)
            exp(z, error)
            add(error, one, error)
            divide(rate, error, error)
            multiply(x, error, x)
            add(weight, x, weight)
            multiply(y, error, y)
            add(mine, y, mine)
            weights[at] = both
        return mixed, moved

    def _shares(self, cell: np.ndarray, ones: np.ndarray, out: np.ndarray) -> np.ndarray:
        """What the map holds at each bit; it learns. Takes the other arrays."""
        map_, stay, add, multiply = self.map, np.float32(1 - MAP_RATE), np.add, np.multiply
        spare = np.empty(cell.shape[1], np.float32)
        for at, one, found in zip(cell, ones, out, strict=True):
            map_.take(at, out=found, mode="clip")
            multiply(found, stay, spare)
            add(spare, one, spare)
            map_[at] = spare
        return out

    def alone(self, lane: int) -> Generator[float, tuple, None]:
        """Goes on with one lane where few are left: takes parts of its bits, gives their costs. The same steps, by number."""
        cells = slice(lane * GATES * 2, (lane + 1) * GATES * 2)
        corpus, own = self.weights.real[cells].tolist(), self.weights.imag[cells].tolist()
        map_ = self.map[lane * GATES * self.columns : (lane + 1) * GATES * self.columns].tolist()
        states = bytearray(self.states[lane * SPAN : (lane + 1) * SPAN])
        values, following, exp, log2 = VALUE.tolist(), AFTER_TWICE.tolist(), math.exp, math.log2
        half, last = MAP_STEP * MAP_HALF + 0.5, self.columns - 0.5
        cost = 0.0
        while True:
            given, bits, gate, slots = yield cost
            cost, product = 0.0, 1.0
            parts = given, bits, gate.astype(np.int64) * 2, gate.astype(np.int64) * self.columns, slots
            for given, bit, cell, line, slot in zip(*(part.tolist() for part in parts), strict=True):
                key = states[slot] + bit
                states[slot] = following[key]
                value = values[key]
                if key > 1:
                    cell += 1
                weight, mine = corpus[cell], own[cell]
                z = weight * given + mine * value
                z = MOST_ODDS if z > MOST_ODDS else -MOST_ODDS if z < -MOST_ODDS else z
                p = 1 / (1 + exp(-z))
                error = (1 - p) * RATE
                corpus[cell] = weight + error * given
                own[cell] = mine + error * value
                place = (z if bit else -z) * MAP_STEP + half
                line += 0 if place < 0 else int(last) if place > last else int(place)
                found = map_[line]
                map_[line] = found + (bit - found) * MAP_RATE
                product *= (p + (found if bit else 1 - found)) / 2
                if product < 1e-200:
                    cost, product = cost - log2(product), 1.0
            cost -= log2(product)


def parts_of(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The corpus's log odds, the bit, the gate and the slot of a block's bits."""
    given = some.astype(np.uint8).view(np.int8) * np.float32(UNIT)
    gate = (some >> np.uint32(8)).astype(np.uint8)
    slot = (some >> np.uint32(32 - OWN_SLOTS)).astype(np.int64)
    return given, gate & np.uint8(1), gate >> np.uint8(1), slot


class Model:
    """What a task needs to score: the code, the two hashed tables, the starting weights and the totals."""

    def __init__(self, code: Code, tables: tuple[np.ndarray, np.ndarray], weights: np.ndarray, tokens: int, distinct: int):
        self.code, self.tables, self.weights, self.tokens, self.distinct = code, tables, weights, tokens, distinct

    def base(self, n: np.ndarray) -> np.ndarray:
        """log10 of the smoothed share of words with these training counts."""
        return np.log10((n + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


class Block:
    """The words of a block by number; all that is known of each of their bits is held in one 32-bit word.

    Its bytes: the corpus's log odds of the bit that comes, its gate and the bit, and two of the hash of the word so far.
    """

    def __init__(self, model: Model, words: pa.Array, n: np.ndarray, known: pa.Array):
        self.model = model
        parts = [
            self._bits(*(some[low : low + SPELL] for some in (words, n, known))) for low in range(0, len(words), SPELL)
        ]
        self.bits, self.sizes, self.bytes = (np.concatenate(part) for part in zip(*parts, strict=True))
        del parts
        self.begin = np.cumsum(self.sizes) - self.sizes

    def _bits(self, words: pa.Array, n: np.ndarray, known: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        model = self.model
        own = Spelled(words, model.code)
        # From where a word's beginning is its own, its count alone decides; nothing is known beyond its known bytes.
        given, sizes = bytes_of(known)
        parts = np.stack([sizes, own.known - sizes, own.sizes - own.known], axis=1).ravel()
        part = np.zeros((len(sizes), 3), np.uint8)
        part[:, 1] = own_byte(n, n)
        found = np.repeat(part.ravel(), parts)
        place = np.arange(sizes.sum()) + np.repeat(own.begin - (np.cumsum(sizes) - sizes), sizes)
        found[place] = given
        weights = (model.weights * UNIT).astype(np.float32)[np.arange(256) >> 5]  # by such a byte
        sign = 2 * own.bit.astype(np.int8) - 1
        z = (OWN_ODDS[np.arange(256) & 31] * weights[:, 2]).take(found)
        for k, slot in enumerate(own.slots()):
            z += (model.tables[k].take(slot) * sign) * weights[:, k].copy().take(found)
        np.clip(z, np.float32(-MOST_ODDS), np.float32(MOST_ODDS), out=z)
        z /= np.float32(UNIT)
        np.rint(z, out=z)
        found >>= np.uint8(4)
        found &= np.uint8(14)
        found |= own.bit
        out = own.beginnings()
        out <<= np.uint32(8)
        out |= found
        out <<= np.uint32(8)
        out |= z.astype(np.int8).view(np.uint8)
        return out, own.sizes, own.bytes

    def costs(self, texts: list[np.ndarray]) -> np.ndarray:
        """Bits of each text."""
        full = np.fromiter((self.sizes[numbers].sum() for numbers in texts), np.int64, len(texts))
        many = -(-full // STRETCH)
        text = np.repeat(np.arange(len(texts)), many)
        low = STRETCH * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
        sizes = np.minimum(STRETCH, full[text] - low)
        order = np.argsort(-sizes, kind="stable")  # the longest first
        cost = np.zeros(len(text))
        for first in range(0, len(order), LANES):
            some = order[first : first + LANES]
            cost[some] = self._read([texts[i] for i in text[some]], low[some], sizes[some])
        return np.bincount(text, cost, len(texts))

    def _read(self, texts: list[np.ndarray], low: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Costs of stretches of texts, ``sizes`` bits from ``low`` on, the longest first, read side by side."""
        words = np.concatenate(texts)
        ends = np.cumsum(self.sizes[words])  # of each word, in the bits of all texts one after the other
        low = low + np.concatenate([[0], ends[np.cumsum([len(numbers) for numbers in texts])[:-1] - 1]])
        high = low + sizes
        lanes, cost = Lanes(len(low)), np.zeros(len(low))
        begin, longest = 0, int(sizes[0])
        while begin < longest:
            used = int(np.searchsorted(-sizes, -begin, "left"))  # those longer than that
            if begin >= LONG and used < FEW:
                break
            steps = min(max(1, GATHERED // used), longest - begin, LONG)
            active = np.searchsorted(-sizes, -(begin + np.arange(steps)), "left")
            a = low[:used] + begin
            z = np.minimum(a + steps, high[:used])
            some = self._bits_between(words, ends, a, z)
            whole = int(active[-1])
            by_step = np.zeros((steps, used), np.uint32)
            by_step[:, :whole] = some[: whole * steps].reshape(whole, steps).T
            if whole < used:
                rest = np.zeros((used - whole, steps), np.uint32)
                rest[np.arange(steps) < (z - a)[whole:, None]] = some[whole * steps :]
                by_step[:, whole:] = rest.T
            rows = max(1, PREPARED // used)
            for row in range(0, steps, rows):
                part = slice(row, row + rows)
                k = int(active[row])
                p = lanes.steps(*parts_of(by_step[part, :k]), active[part])
                fours = len(p) // 4  # four at a time: none is below 1e-6, so their product is a normal number
                for some in (np.multiply.reduce(p[: 4 * fours].reshape(4, fours, k)), p[4 * fours :]):
                    cost[:k] -= np.log2(some).sum(axis=0, dtype=np.float64)
            begin += steps
        for lane in range(used if begin < longest else 0):
            alone = lanes.alone(lane)
            next(alone)
            for a in range(int(low[lane]) + begin, int(high[lane]), LONG):
                z = min(a + LONG, int(high[lane]))
                cost[lane] += alone.send(parts_of(self._bits_between(words, ends, np.array([a]), np.array([z]))))
        return cost

    def _bits_between(self, words: np.ndarray, ends: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The bits from each ``low`` to its ``high``, one range after the other."""
        word, until = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "left") + 1
        many, size = until - word, high - low
        first = np.cumsum(many) - many
        mine = np.arange(many.sum()) + np.repeat(word - first, many)
        edge = np.minimum(ends[mine], np.repeat(high, many))
        before = np.concatenate([[0], edge[:-1]])
        before[first] = low
        own = words[mine]
        moved = self.begin[own] + self.sizes[own] - ends[mine] + np.repeat(low - (np.cumsum(size) - size), many)
        return self.bits.take(np.repeat(moved, edge - before) + np.arange(size.sum()))


PACKED_ROWS = 1 << 16


def packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(block, number, word, n, body)`` to ``(block, words)``: many rows of a block as one compressed table."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")

    def flushed(rows: pa.Table) -> pa.RecordBatch:
        block = rows.column("block").to_numpy()
        order = np.argsort(block, kind="stable")
        cuts = np.flatnonzero(np.diff(block[order], prepend=-1))
        rows = rows.drop_columns("block").take(pa.array(order)).combine_chunks()
        blobs = []
        for low, high in zip(cuts.tolist(), [*cuts.tolist()[1:], len(order)], strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                writer.write_table(rows.slice(low, high - low))
            blobs.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(block[order][cuts]), pa.array(blobs, pa.binary())], ["block", "words"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= PACKED_ROWS:
            yield flushed(pa.Table.from_batches(held))
            held, rows = [], 0
    if rows:
        yield flushed(pa.Table.from_batches(held))


SCORED = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
    "text_bytes long, bits_per_byte double"
)


def score_blocks(model: Model):
    """A block's texts and words to its scores."""

    def each(texts: pa.Table, known: pa.Table) -> pa.Table:
        known = pa.concat_tables([pa.ipc.open_stream(blob).read_all() for blob in known.column("words")])
        known = known.take(pa.array(np.argsort(known.column("number").to_numpy()))).combine_chunks()
        n = known.column("n").to_numpy()
        block = Block(model, known.column("word").chunk(0), n, known.column("body").chunk(0))
        del known
        packed = texts.column("body").to_pylist()
        place = {body: i for i, body in enumerate(dict.fromkeys(packed))}  # equal texts are read once
        unlike = [unpacked_numbers(body) for body in place]
        rows = [place[body] for body in packed]
        cost = block.costs(unlike)[rows]
        words, held = np.concatenate(unlike), np.fromiter(map(len, unlike), np.int64, len(unlike))
        start = np.cumsum(held) - held
        length = np.add.reduceat(block.bytes.take(words), start)[rows]
        met = np.add.reduceat((n > 0).astype(np.int64).take(words), start)[rows]
        base = model.base(n).take(words)
        base = np.array([base[a : a + many].sum() for a, many in zip(start.tolist(), held.tolist(), strict=True)])[rows]
        return pa.table(
            {
                "doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"),
                "n_tokens": held[rows], "n_known": met, "train_tokens": np.full(len(rows), model.tokens),
                "base_score": base, "score": -cost * math.log10(2),
                "text_bytes": length, "bits_per_byte": cost / length,
            }
        )

    return each


# --- on Spark


def kept_by_kind(df: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Writes once; the rows of kinds TEXT and WORD as two tables."""
    path = work_folder(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    written = (df.sparkSession.read.schema(df.schema).parquet(path) for _ in range(2))
    return tuple(rows.where(F.col("kind") == kind) for rows, kind in zip(written, (TEXT, WORD), strict=True))


def hashed_tables(words: DataFrame, code: Code) -> tuple[np.ndarray, np.ndarray]:
    """Log odds by slot: at most 2 ** SLOTS2 + 2 ** SLOTS4 rows reach the driver, whatever the corpus."""
    counted = words.mapInArrow(slot_rows(code), "slot int, zeros long, ones long")
    summed = counted.groupBy("slot").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    unit = F.rint(F.log((F.col("ones") + 0.4) / (F.col("zeros") + 0.4)) / UNIT)
    limit = int(MOST_ODDS / UNIT)
    rows = summed.select("slot", F.least(F.greatest(unit, F.lit(-limit)), F.lit(limit)).cast("byte").alias("odds")).toArrow()
    out = np.zeros((1 << SLOTS2) + (1 << SLOTS4), np.int8)
    out[rows.column("slot").to_numpy()] = rows.column("odds").to_numpy()
    return out[: 1 << SLOTS2], out[1 << SLOTS2 :]


def scores(documents: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, text_bytes, bits_per_byte)``."""
    spark = documents.sparkSession
    rows = documents.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    texts, words = kept_by_kind(rows.mapInArrow(read_rows, READ), "texts")
    path = work_folder(spark, "words")
    words.groupBy("word").agg(F.sum("n").alias("n")).write.parquet(path)
    counted = spark.read.schema("word binary, n long").parquet(path)
    every, tokens, distinct = counted.agg(
        F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, True))
    ).first()
    seen = counted.mapInArrow(histogram_rows, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    histogram = np.zeros(1 << 16, np.int64)
    histogram[seen.column("pair").to_numpy()] = seen.column("n").to_numpy()
    code = Code(histogram)
    tables = hashed_tables(counted, code)
    ranges = ranged(counted, code, max(1, -(-every // RANGE_WORDS)))
    found = ranges.groupBy("range").applyInArrow(
        border_rows(code), "range int, first binary, last binary, first_sums array<long>, last_sums array<long>"
    )
    borders = outside(sorted(tuple(row) for row in found.collect()))
    known = ranges.groupBy("range").applyInArrow(known_rows(code, tables, borders), KNOWN)
    cells, known = kept_by_kind(known, "known")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    weights = starting_weights(cells.column("cell").to_numpy().astype(np.int64), cells.column("n").to_numpy())
    model = Model(code, tables, weights, tokens, distinct)
    mine = words.select("block", "number", "word").join(known.select("word", "n", "body"), "word")
    mine = mine.select("block", "number", "word", "n", "body").mapInArrow(packed_rows, "block long, words binary")
    return (
        texts.select("block", "doc_id", "held_out", "body")
        .groupBy("block")
        .cogroup(mine.groupBy("block"))
        .applyInArrow(score_blocks(model), SCORED)
    )


def ranged(counted: DataFrame, code: Code, parts: int) -> DataFrame:
    """``(range, word, n)``, written: words dealt by the order of their codes."""
    path = work_folder(counted.sparkSession, "ranges")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, code.places(batch.column("word"))], ["word", "n", "place"])

    placed = counted.mapInArrow(keyed, "word binary, n long, place binary").repartitionByRange(parts, "place")
    placed.select(F.spark_partition_id().alias("range"), "word", "n").write.parquet(path)
    return counted.sparkSession.read.schema("range int, word binary, n long").parquet(path)
