"""Runs against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from duewatch.llm.periodic_runs import WaveletTree, collapsed, periodic_runs, planted, runs_of, strongest


def plain_runs(x):
    found = {}
    for q in range(1, len(x) // 3 + 1):
        i = 0
        while i + q < len(x):
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(x) and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(24, 3 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def check(texts):
    assert runs_of([np.array(t, np.int64) for t in texts]) == [plain_runs(t) for t in texts]


def nested(rng, depth):
    """A sequence made of repeated sequences, with breaks."""
    x = [rng.randrange(3) for _ in range(rng.randint(1, 4))]
    for _ in range(depth):
        x = x * rng.randint(1, 5) + [rng.randrange(3) for _ in range(rng.randint(0, 3))]
        if rng.random() < 0.3:
            x = x[rng.randint(0, len(x) // 3) :]
    return x[:700]


def test_nested_periods():
    rng = random.Random(3)
    for _ in range(60):
        check([nested(rng, rng.randint(1, 5)) for _ in range(6)])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=120), min_size=1, max_size=4))
def test_few_letters(texts):
    check(texts)


@pytest.mark.parametrize("period", [1, 2, 5, 6, 7, 8, 9, 15, 16, 17, 31, 33, 100])
def test_every_period_at_its_shortest(period):
    rng = random.Random(period)
    own = [1000 + rng.randrange(5) if period < 4 else 1000 + i for i in range(period)]
    long = max(24, 3 * period)
    for size in (long - 1, long, long + 5):
        for lead in range(0, 20, 3):
            check([list(range(lead)) + (own * (size // period + 1))[:size] + list(range(50, 60))])


def test_same_text_twice_in_a_batch_and_empty_ones():
    x = [1, 2, 3] * 10
    check([x, [], x, [5], [], list(range(40)) + x])
    assert runs_of([]) == [] and runs_of([np.zeros(0, np.int64)]) == [[]]


def test_successor():
    rng = np.random.default_rng(0)
    values = rng.permutation(200)
    tree = WaveletTree(values)
    low = rng.integers(0, 200, 500)
    high = low + rng.integers(0, 200 - low + 1)
    least = rng.integers(0, 201, 500)
    for a, b, x, got in zip(low, high, least, tree.successor(low, high, least), strict=True):
        assert got == min((v for v in values[a:b] if v >= x), default=-1)


def test_ties_take_the_first_start():
    assert strongest([(0, 24, 2), (30, 36, 3), (30, 24, 2)]) == (0, 24, 2)
    assert strongest([(0, 25, 2), (30, 26, 2)]) == (30, 26, 2)
    assert strongest([]) is None


def expected(doc_id, text, rewrite):
    words = (text or "").encode().split()
    if rewrite and doc_id is not None and words and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g, n = zlib.crc32(str(doc_id).encode()) // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s).hexdigest()
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
        sha(b" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_documents(spark):
    rng = random.Random(5)
    vocabulary = ["ab", "é", "Ab", "x" * 40, ","]
    rows = [(None, "a " * 30), (1, None), (2, ""), (3, " \t\n"), (4, "a\x0b" * 23), (5, "a b " * 24), (6, "a " * 24)]
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 300)))) for i in range(7, 120)]
    rows += [(6, "a " * 24), (7, None)]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, n_runs string, start string")
    for rewrite in (False, True):
        got = sorted((tuple(r)[:8] for r in periodic_runs(docs, rewrite).collect()), key=str)
        assert got == sorted((expected(*r, rewrite) for r in rows), key=str)
    assert periodic_runs(docs.limit(0)).collect() == []


def test_a_long_text(spark):
    words = [str(i) for i in range(3000)] * 12
    text = " ".join(words)
    (row,) = periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (row.n_runs, row.start, row.length, row.period, row.n_dropped) == (1, 0, 36000, 3000, 33000)


def test_planting_keeps_the_number_of_words():
    for i in range(400):
        words = [str(k).encode() for k in range(i % 37)]
        assert len(planted(i, words)) == len(words)
    assert collapsed([b"a"] * 24, [(0, 24, 1)]) == [b"a"]
