"""Variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from duewatch.llm import spelling
from duewatch.llm.spelling import Cells, Tree, letters_of, near_words, one_edit, rounds, signatures, variants, vectors


def edit_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = 1 if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if v != w and edit_one(w, v)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 5 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def corpus(rng, documents=60):
    """Frequent words, their misspellings of misspellings, anagrams, accents and capitals."""
    base = ["".join(rng.choice("abdeiklmnorstuéü×") for _ in range(rng.randint(6, 9))) for _ in range(12)]
    bag = []
    for word in base:
        bag += [word] * 130
        for _ in range(4):
            at = rng.randrange(len(word))
            once = word[:at] + rng.choice(["", "x", "ab"]) + word[at + 1 :]
            bag += [once] * rng.randint(1, 26)
            bag += ["".join(rng.sample(word, len(word)))] * 6
            at = rng.randrange(len(once))
            bag += [once[:at] + "z" + once[at:]] * rng.randint(1, 6)
    rng.shuffle(bag)
    texts = [" ".join(bag[i::documents]) for i in range(documents)]
    return [(i * 7, t.upper() if i % 9 == 0 and t.isascii() else t.title() if i % 4 == 0 else t) for i, t in enumerate(texts)]


def checked(spark, rows, extra=True):
    docs = spark.createDataFrame([(*r, "w", 3) for r in rows], "doc_id long, text string, word string, n int").repartition(5)
    got = sorted(tuple(r) for r in variants(docs).collect())
    assert got == plain_variants(rows)
    return got


def test_all_pairs(spark):
    rows = corpus(random.Random(1))
    rows += [(None, rows[0][1]), (5, None), (6, ""), (7, "12 ,; 中文"), rows[3], rows[3]]
    got = checked(spark, rows)
    assert any(form and form != root for _, form, root, *_ in got)
    assert any(form is None for _, form, *_ in got)


def test_many_small_cells(spark, monkeypatch):
    """Cells, parts of words and sides of questions at sizes that split nearly everything."""
    monkeypatch.setattr(spelling, "CELL_WORDS", 12)
    monkeypatch.setattr(spelling, "CELL_QUESTIONS", 20)
    monkeypatch.setattr(spelling, "CUT_FROM", 4)
    monkeypatch.setattr(spelling, "LEAF", 3)
    rng = random.Random(2)
    rows = corpus(rng)
    # anagrams: no cut separates them
    words = {"".join(rng.sample("aabbccdd", 8)) for _ in range(90)}
    rows += [(1000 + i, " ".join(words)) for i in range(6)]
    checked(spark, rows)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants(docs).collect() == []
    assert checked(spark, [(1, "short words only, no one of six")]) == []


def test_very_long_words(spark):
    long = "abcdefghij" * 3000
    rows = [(i, f"{long} {long}x {long[:-1]}b") for i in range(5)] + [(9, f"{long} " * 30)]
    assert sorted(r[4] for r in checked(spark, rows)) == [1, 1, 2]


def test_parts_of_the_search():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcé") for _ in range(7)).encode("latin-1") for _ in range(400)]
    counts = vectors(letters_of(words, 7))
    far = np.abs(counts[:, None].astype(int) - counts[None]).sum(axis=2)
    sign = signatures(counts)
    assert (np.bitwise_count(sign[:, None] ^ sign[None]) <= far).all()
    seen = {(int(i), int(j)) for points, rows in Tree(counts).near(counts, 2) for i in rows for j in points}
    assert {(i, j) for i, j in np.argwhere(far <= 2).tolist()} <= seen
    cells = Cells(counts, 2000.0)
    home = {int(row): cell for cell, rows in cells.dealt(counts, 0) for row in rows}
    assert len(home) == 400 and len(set(home.values())) > 4
    asked = {(int(row), cell) for cell, rows in cells.dealt(counts, 2) for row in rows}
    assert {(i, home[j]) for i, j in np.argwhere(far <= 2).tolist()} <= asked


def test_one_edit():
    rng = random.Random(6)
    for _ in range(2000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(6, 7))).encode()
        b = "".join(rng.choice("ab") for _ in range(rng.randint(6, 7))).encode()
        a, b = sorted((a, b), key=len)
        got = one_edit(letters_of([a], len(a)), letters_of([b], len(b)))[0]
        assert got == edit_one(a.decode(), b.decode())


def test_rounds_reach_the_end():
    for most in (0, 5, 24, 25, 124, 125, 10**6, 10**12):
        links, n = 0, 5
        while n * 5 <= most:
            links, n = links + 1, n * 5
        assert 2 ** rounds(most) >= links


def test_long_chains_of_forms(spark):
    chain = ["abcdefghij"[:i] + "k" * (10 - i) for i in range(9)]
    rows = [(None, f"{word} " * (5 ** (i + 1) if i < 5 else 0)) for i, word in enumerate(chain)]
    got = checked(spark, rows)
    assert {r[2] for r in got} == {chain[4]} and len(got) == 5


def test_pairs_are_counted_once(spark):
    words = spark.createDataFrame([(w.encode(), n) for w, n in [("abcdef", 9), ("abcdefg", 8), ("abcdeg", 8)]], "word binary, n long")
    got = {bytes(r.word).decode(): (r.n_near, r.best_n, bytes(r.best).decode()) for r in near_words(words).collect()}
    assert got == {"abcdef": (2, 8, "abcdefg"), "abcdefg": (2, 9, "abcdef"), "abcdeg": (2, 9, "abcdef")}
