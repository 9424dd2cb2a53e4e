"""Seeds and alignment against a plain Smith-Waterman, and planted passages."""

import random

import numpy as np

from duewatch.llm.decontamination import GAP, MATCH, MISMATCH, align, found_leaks, without_leaks


def plain(a, b):
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, last[j] + (MATCH if x == y else MISMATCH), last[j + 1] + GAP, now[j] + GAP))
        best, last = max(best, *now), now
    return best


def test_alignment():
    rng = np.random.default_rng(2)
    a = [rng.integers(1, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(60)]
    b = [rng.integers(1, 6, rng.integers(1, 50)).astype(np.uint64) for _ in range(60)]
    assert align(a, b)[0].tolist() == [plain(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]


def words(rng, n):
    common = [f"c{k}" for k in range(30)]
    return [rng.choice(common) if rng.random() < 0.6 else f"r{rng.randrange(5000)}" for _ in range(n)]


def test_planted_passages(spark, make):
    rng = random.Random(8)
    items = [words(rng, rng.randint(20, 60)) for _ in range(12)]
    benchmark = [(k, " ".join(x), "n") for k, x in enumerate(items)] + [(90, None, "n"), (91, "c1 c2", "n"), (92, "", "n"), (None, "c1 c2 c3 c4", "n")]
    rows, wanted = [], set()
    for k in range(300):
        text, item = words(rng, rng.randint(30, 600)), items[k % 12]
        if k % 3 == 0:
            copy = list(item)
            if k % 2:
                for _ in range(len(copy) // 8):
                    at = rng.randrange(len(copy))
                    copy[at : at + 1] = rng.choice([[], ["odd"], [copy[at], "more"]])
            at = rng.randrange(len(text))
            text[at:at] = [x.upper() + "," for x in copy]
            wanted.add((k, k % 12))
        rows.append((k, " ".join(text)))
    rows += [(None, " ".join(items[0])), (700, None), (701, ""), (702, " ".join(items[3] * 50)), (703, " ".join(items[3])), (703, " ".join(items[3]))]
    wanted |= {(None, 0), (702, 3), (703, 3)}
    df = make(rows)
    items_df = spark.createDataFrame(benchmark, "item_id long, text string, doc_id string")
    found = found_leaks(df, items_df).collect()
    assert {(r.doc_id, r.item_id) for r in found} == wanted and len(found) == len(wanted) + 1
    exact = next(r for r in found if r.doc_id == 703)
    assert (exact.score, exact.first_word, exact.last_word) == (1.0, 0, len(items[3]) - 1)
    kept = without_leaks(df, items_df)
    assert kept.columns == df.columns
    leaked = {doc for doc, _ in wanted}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _ in rows if d not in leaked)


def test_a_passage_in_every_document_is_still_found(spark, make):
    item = [f"x{k}" for k in range(30)]
    rows = [(k, " ".join([f"a{k}", *item, f"b{k}"])) for k in range(200)]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert found_leaks(make(rows), items).count() == 200


def test_a_copy_behind_a_late_seed_at_the_head(spark, make):
    item = [f"x{k}" for k in range(40)]
    rows = [(k, " ".join([*item[-3:], *(f"f{k}w{i}" for i in range(k - 3)), *item, "end"])) for k in (3, 15, 25, 45, 59, 90)]
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    found = {r.doc_id: (r.score, r.first_word) for r in found_leaks(make(rows), items).collect()}
    assert found == {k: (1.0, k) for k, _ in rows}
    assert without_leaks(make(rows), items).count() == 0


def test_empty_tables(spark, make):
    items = spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string")
    assert found_leaks(make([]), items).collect() == []
    assert found_leaks(make([(1, "a b c")]), items.limit(0)).collect() == []
    assert without_leaks(make([(1, "a b c")]), items.limit(0)).count() == 1
