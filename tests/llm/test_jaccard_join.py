"""The join against all pairs."""

import random
import re

import pytest

from duewatch.llm.common import components
from duewatch.llm.jaccard_join import FREQUENT, jaccard_components, joined_groups, signatures


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(text) for _, text in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(a & sets[j])
            if shared and 100 * shared >= 80 * (len(a) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    least = {}
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(k)] = min(least.get(find(k), doc), doc)
    return sorted(
        ((d, len(sets[k]), least.get(find(k), d) if sets[k] else d) for k, (d, _) in enumerate(rows)),
        key=repr,
    )


def ours(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(df).collect()), key=repr)


def edited(words, rng, most):
    out = list(words)
    for _ in range(rng.randint(0, most)):
        at = rng.randrange(len(out))
        out[at : at + 1] = rng.choice([[], [f"n{rng.randrange(6)}"], [out[at], "extra"]])
    return " ".join(out)


@pytest.mark.parametrize("family", [FREQUENT // 2, 5 * FREQUENT])
def test_families_of_near_copies_and_shared_passages(make, family):
    rng = random.Random(family)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for base in range(2):
        words = [f"b{base}w{rng.randrange(500)}" for _ in range(90)]
        rows += [(len(rows) + k, edited(words, rng, 6)) for k in range(family)]
    for k in range(family):
        own = [f"o{k}x{i}" for i in range(rng.choice([8, 20, 70]))]
        rows.append((10_000 + k, " ".join(passage + own if k % 2 else own + passage)))
    rng.shuffle(rows)
    assert ours(make(rows)) == brute(rows)


def test_nulls_empty_short_and_repeated(make):
    rows = [(9, None), (8, ""), (7, " \t"), (6, "one"), (5, "ONE"), (4, "a b c d"), (3, "A  b\nc d"), (2, "é a"), (1, "É a"),
            (0, "a b c d e"), (0, "a b c d e"), (None, "a b c d e"), (None, None), (11, "x " * 3000), (12, "x x x x x"),
            (13, "y" * 100_000), (14, "a b c")]
    assert ours(make(rows)) == brute(rows)


def test_repeated_rows_beside_a_half_overlap(make):
    common = [f"w{i}" for i in range(54)]
    one, two, three = (" ".join([*common, *(f"{x}{i}" for i in range(50))]) for x in "abc")
    rows = [(5, one)] * 2 + [(7, two), (None, three), (None, three), (None, three)]
    assert ours(make(rows)) == brute(rows)
    assert ours(make(rows, 1)) == brute(rows)


def test_unlike_texts_under_one_id(make):
    words = [f"w{i}" for i in range(100)]
    rows = [(3, " ".join(words)), (3, " ".join([*words[:96], "q", "r"])), (1, " ".join([*words[8:96], "q", "r"])),
            (3, " ".join(f"z{i}" for i in range(40))), (3, " ".join(f"z{i}" for i in range(2, 40))), (8, "z0 other text of few words")]
    many = [f"m{i}" for i in range(60)]
    rows += [(20, " ".join([*many[: 60 - k], f"t{k}"])) for k in range(30)]
    assert ours(make(rows)) == brute(rows)


def test_many_exact_copies_are_one_node(make):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(k, text if k % 3 else f"{text} tail{k}") for k in range(300)]
    assert ours(make(rows, 12)) == brute(rows)


def test_empty_table(make):
    assert ours(make([])) == []
    assert ours(make([(1, None)])) == [(1, 0, 1)]


def test_linked_sets_share_a_signature():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (2, 3, 4, 5, 9, 31, 64, 200, 900):
        for _ in range(20):
            common = rng.integers(1, 1 << 60, n).astype(np.uint64)
            cut = rng.integers(0, n // 5 + 1)
            a, b = common, np.concatenate([common[cut // 2 :], rng.integers(1, 1 << 60, cut // 2).astype(np.uint64)])
            shared = len(np.intersect1d(a, b))
            if 100 * shared < 80 * (len(a) + len(b) - shared) or len(b) < 2:
                continue
            level = {int(t): int(t) % 12 for t in np.concatenate([a, b])}
            found = []
            for tokens in (a, b):
                order = sorted(tokens.tolist(), key=lambda t: (level[t], t))
                found.append(set(signatures(np.array([level[t] for t in order]), np.array(order, np.uint64))[0].tolist()))
            assert found[0] & found[1]


def test_later_links_join_components(spark):
    node = lambda i: bytes([i]) * 16
    links = [(1, 2), (2, 3), (5, 6), (7, 8), (8, 9)]
    more = [(3, 6), (9, 11), (12, 13), (13, 14), (3, 5)]
    frame = lambda pairs: spark.createDataFrame([(bytearray(node(a)), bytearray(node(b))) for a, b in pairs], "a binary, b binary")
    groups = joined_groups(components(frame(links)), frame(more))
    got = {(bytes(r.node)[0], bytes(r.component)[0]) for r in groups.collect()}
    assert got == {(bytes(r.node)[0], bytes(r.component)[0]) for r in components(frame(links + more)).collect()}
    assert groups.count() == len(got)
