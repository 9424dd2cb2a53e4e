"""Packing: every id once, no padding, and the tokenizer's own ids."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from duewatch.llm.packing import Encoder, Levels, Stream, packed

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a <|startoftext|> b<|endoftext|>c", "<|", "x y　z  w", "é ́a don't I'LL 12 3a\u0000b", "İstanbul ΣΑΣ Σ", "日本語です。 한",
    "a\x1cb\x85c ​", "", " \n", None, "'s 's'", "ﬁ ½ ² x²", "ÉTÉ été. Été, été!? ǅ ŒUVRE", "don't. it's, a-. (b) x.y... z.;, &amp;", "word " * 9000, "z" * 30_000,
]


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


def test_word_ids_are_the_tokenizers(plain):
    for text, found in zip(ODD, Encoder(PATH).batch(ODD), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids, text


def test_every_id_lies_in_one_piece(make, plain):
    rows = [(k, text) for k, text in enumerate(ODD * 3)] + [(None, "no id"), (5, "same id again"), (5, "same id again")]
    wanted = defaultdict(list)
    for doc, text in rows:
        wanted[doc].append([*plain.encode(text or "", add_special_tokens=False).ids, 1])
    sequences, tokens = defaultdict(list), defaultdict(int)
    for r in packed(make(rows), PATH).collect():
        sequences[r.sequence_id].append((r.offset, r.length))
        tokens[r.doc_id] += r.length
        known = [x[r.start : r.start + r.length] for x in wanted[r.doc_id] if len(x) == r.doc_tokens]
        assert r.ids_crc32 in [zlib.crc32(np.array(x, "<u4").tobytes()) for x in known]
    assert tokens == {doc: sum(map(len, x)) for doc, x in wanted.items()}
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and at & (at - 1) == 0


def test_empty_table(make):
    assert packed(make([]), PATH).collect() == []


def test_the_level_chosen_minimises_the_sum_of_squares():
    rng = np.random.default_rng(3)
    levels = Levels(32)
    for _ in range(400):
        size = int(rng.integers(1, 32))

        def after(level, size=size):
            count = levels.count.copy()
            if level:
                count[level] -= 1
            count[level + size] += 1
            return int((count[1:32] ** 2).sum())

        open_levels = [h for h in range(1, 33 - size) if levels.count[h]]
        level = levels.place(size)
        assert after(level) == min(after(h) for h in [0, *open_levels])
        window = levels.take(level) if level else 0
        if level + size < 32:
            levels.put(level + size, window)


def test_stream_ends_without_padding():
    rng = np.random.default_rng(1)
    stream, out = Stream(0, 64), []
    for k in range(500):
        out += stream.add(k, np.arange(rng.integers(1, 200), dtype="<u4"))
    out += stream.finish()
    fill = defaultdict(int)
    for _, _, ids, _, sequence, _ in out:
        fill[sequence] += len(ids)
    assert all(x & (x - 1) == 0 and x <= 64 for x in fill.values())


def test_a_batch_does_not_walk_the_older_words():
    """Each batch asks the older words by key only, however many there are."""

    class Older(dict):
        def __iter__(self):
            raise AssertionError("walked")

    coder = Encoder(PATH)
    coder.older = Older({b"kept": coder.whole(b"kept")})
    assert coder.batch(["kept new"]) == Encoder(PATH).batch(["kept new"])
    assert b"kept" in coder.known
