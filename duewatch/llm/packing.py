"""Sum-of-squares online packing of token sequences.

Each document becomes token ids with one end id behind. Whole windows of ``WINDOW`` ids are cut off first; the rest, a
piece smaller than a window, goes to the fill level that minimises the sum of squared counts of partially filled
windows, tracked in an array of counts by level. Every input partition packs its own stream, so there is no shuffle and
no common state; a sequence's id is its partition's number and its place in the stream.

Windows still open when a stream ends are closed by cutting: the emptiest ones fill the fullest, and what remains is
cut into powers of two, which need no padding. The ids of a text are those of its words, parted at white space, one
after another: neither the vocabulary's rules nor its normal form reach across white space. So each task keeps the ids
of words it has met and encodes a word once. The vocabulary is a lower-case one.

Null and empty texts are one end id. Repeated rows are packed each; the id column may hold nulls; extra columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END_ID = 1
#: New words after which a task lets go of those it has not met since it last did; only bounds its memory.
KEPT_WORDS = 400_000
#: A special string of the vocabulary that parts words while many are encoded at once.
PARTING, PARTING_ID = "<|startoftext|>", 49406
#: Marks that end a word of letters; apostrophes are not among them, as some belong to the word.
MARKS = b".,;:!?*#$%&|"
#: Byte-level vocabularies write printable bytes as themselves and the others, in order, from code point 256 on.
PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_LETTERS = {x: 256 + k for k, x in enumerate(x for x in range(256) if x not in PRINTABLE)}
PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Words (UTF-8, ASCII letters in lower case) to their ids as little-endian 32-bit integers.

    A word of letters is one piece to the tokenizer, so its model is asked directly; marks behind it are a piece of
    their own. All other words go through the whole tokenizer, many in one call.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.four = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def whole(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def letters(self, stem: bytes) -> bytes | None:
        """Ids of a word of lower-case letters in normal form, else None."""
        found = self.known.get(stem) or self.older.get(stem)
        if found is None:
            text = stem.decode("utf-8", "replace")
            if not stem.isalpha():  # ASCII letters stand for themselves in the vocabulary
                if not (text.isalpha() and text.lower() == text and is_normalized("NFC", text)):
                    return None
                text = stem.decode("latin-1").translate(BYTE_LETTERS)
            found = self.known[stem] = b"".join([self.four[piece.id] for piece in self.model.tokenize(text)])
        return found

    def learn(self, words: list[bytes]) -> None:
        plain, odd = [], []
        for word in words:
            stem = word.rstrip(MARKS)
            ids = self.letters(stem)
            if ids is None:
                (odd if b"<|" in word else plain).append(word)
            elif stem != word:
                tail = word[len(stem) :]
                if tail not in self.known:
                    self.known[tail] = self.whole(tail)
                self.known[word] = ids + self.known[tail]
        for word in odd:
            self.known[word] = self.whole(word)
        for low in range(0, len(plain), 2000):
            part = plain[low : low + 2000]
            text = PARTING.join(word.decode("utf-8", "replace") for word in part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(ids == PARTING_ID)
            data, begin = ids.tobytes(), 0
            for word, end in zip(part, [*(4 * cuts).tolist(), len(data)], strict=True):
                self.known[word] = data[begin:end]
                begin = end + 4

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        split = [text.encode("utf-8", "replace").lower().split() if text else [] for text in texts]
        met = set().union(*split)
        fresh = met.difference(self.known)
        if len(self.known) + len(fresh) > KEPT_WORDS:
            self.known, self.older, fresh = {}, self.known, met
        again = {word for word in fresh if word in self.older}  # a set's intersection would walk all older words
        self.known.update((word, self.older[word]) for word in again)
        self.learn(list(fresh.difference(again)))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Levels:
    """Open windows by fill level, and the choice of a level for a piece."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window)]

    def place(self, size: int) -> int:
        """The level to put a piece on: 0 opens a window. Of equal levels, the fullest."""
        count = self.count
        # Moving one window from level h to h + size changes the sum of squares by 2 * (count[h+size] - count[h] + 1);
        # opening one adds 2 * count[size] + 1, filling one takes 2 * count[h] - 1.
        best, level = 2 * int(count[size]) + 1 if size < self.window else 0, 0
        levels = np.flatnonzero(count[1 : self.window - size + 1]) + 1
        if len(levels):
            after = levels + size
            change = np.where(
                after < self.window, 2 * (count[after % self.window] - count[levels] + 1), 1 - 2 * count[levels]
            )
            k = len(change) - 1 - int(np.argmin(change[::-1]))
            if change[k] <= best:
                level = int(levels[k])
        return level

    def take(self, level: int) -> int:
        self.count[level] -= 1
        return self.open[level].pop()

    def put(self, level: int, window: int) -> None:
        self.count[level] += 1
        self.open[level].append(window)


class Stream:
    """Packs one partition's documents. ``rows`` gathers (document, start, ids, total, sequence, offset)."""

    def __init__(self, first: int, window: int = WINDOW):
        self.window, self.next = window, first
        self.levels = Levels(window)
        self.held: dict[int, list[tuple]] = {}

    def fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, document, ids: np.ndarray) -> Iterator[tuple]:
        total = len(ids)
        whole = total - total % self.window
        for at in range(0, whole, self.window):
            yield document, at, ids[at : at + self.window], total, self.fresh(), 0
        size = total - whole
        if not size:
            return
        piece = (document, whole, ids[whole:].copy(), total)
        level = self.levels.place(size)
        sequence = self.levels.take(level) if level else self.fresh()
        held = self.held.pop(sequence, [])
        held.append((*piece, sequence, level))
        if level + size == self.window:
            yield from held
        else:
            self.held[sequence] = held
            self.levels.put(level + size, sequence)

    def finish(self) -> Iterator[tuple]:
        """Closes the open windows: the emptiest fill the fullest, the last is cut into powers of two."""
        order = sorted(self.held, key=lambda s: -sum(len(p[2]) for p in self.held[s]))
        loose: list[tuple] = []
        low, high = 0, len(order) - 1
        while low <= high:
            sequence, rows, filled = order[low], [], 0
            for piece in self.held[sequence]:
                rows.append((*piece[:4], sequence, filled))
                filled += len(piece[2])
            low += 1
            while filled < self.window and (loose or low <= high):
                if not loose:
                    loose = [piece[:4] for piece in self.held[order[high]]]
                    high -= 1
                rows.append((*self.cut(loose, self.window - filled), sequence, filled))
                filled += len(rows[-1][2])
            if filled < self.window:
                loose = [row[:4] for row in rows]
            else:
                yield from rows
        yield from self.powers(loose)

    @staticmethod
    def cut(loose: list[tuple], room: int) -> tuple:
        """Takes the last piece, or as much of its front as there is room for."""
        document, start, ids, total = loose.pop()
        if len(ids) > room:
            loose.append((document, start + room, ids[room:], total))
        return document, start, ids[:room], total

    def powers(self, loose: list[tuple]) -> Iterator[tuple]:
        """Pieces that fill no further window, in new windows whose lengths are powers of two."""
        rest = sum(len(piece[2]) for piece in loose)
        while rest:
            room = 1 << (rest.bit_length() - 1)
            rest -= room
            sequence, filled = self.fresh(), 0
            while filled < room:
                row = (*self.cut(loose, room - filled), sequence, filled)
                filled += len(row[2])
                yield row


def packer(path: str, window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapper from (doc_id, text) to the rows of the placed pieces."""

    def batch_of(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        document, start, ids, total, sequence, offset = zip(*rows, strict=True)
        columns = [
            pa.array(document, kind),
            pa.array(start, pa.int64()),
            pa.array([len(x) for x in ids], pa.int64()),
            pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
            *(pa.array(x, pa.int64()) for x in (total, sequence, offset)),
        ]
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = Stream(TaskContext.get().partitionId() << 40, window)
        coder = encoder(path)
        end = np.array([END_ID], "<u4").tobytes()
        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows: list[tuple] = []
                coded = coder.batch(part.column("text").to_pylist())
                for document, ids in zip(part.column("doc_id").to_pylist(), coded, strict=True):
                    rows.extend(stream.add(document, np.frombuffer(ids + end, "<u4")))
                if rows:
                    yield batch_of(rows, kind)
        rows = list(stream.finish())
        if rows:
            yield batch_of(rows, kind)

    return run


def packed(documents: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """A row for each piece of each row of ``documents(doc_id, text)``: where its ids lie."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(packer(tokenizer, window), f"doc_id {kind}, {PIECES}")
