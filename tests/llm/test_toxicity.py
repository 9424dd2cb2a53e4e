"""The network: gradients, windows, held-out accuracy, odd rows."""

import random

import numpy as np
import pytest

from duewatch.llm import toxicity as T


def corpus(rng, count):
    """Clean syllable texts, and toxic ones with one to four inflected roots somewhere."""
    rows = []
    for _ in range(count):
        words = ["".join(rng.choice("ka lo mi ne ru ta so".split()) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 400))]
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(1, 4) if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["vilgrub", "stenk"]) + rng.choice(["", "ka", "lomi", "ru", "!!", "nene"])
        rows.append((" ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def model():
    rows = corpus(random.Random(1), 400)
    return T.fit([t for t, _ in rows], np.array([y for _, y in rows]))


def test_held_out_accuracy_and_new_inflections(model):
    rows = corpus(random.Random(2), 300)
    found = T.scores(model, T.Inputs(model), [t for t, _ in rows])
    right = sum((s >= 0.7) == (y == 1) for s, (_, y) in zip(found, rows, strict=True))
    assert right >= 0.97 * len(rows)
    fresh = T.scores(model, T.Inputs(model), ["lo mi vilgrubsoso ka", "lo mi kasoso ka", None, "", "mi " * 20_000])
    assert fresh[0] >= 0.7 and (fresh[1:] < 0.7).all() and fresh[2] == fresh[3]


def test_a_toxic_word_anywhere_in_a_long_text_is_seen(model):
    words = ["lomi"] * 5000
    for at in (0, 63, 2500, 4999):
        text = " ".join([*words[:at], "stenkru", *words[at + 1 :]])
        assert T.scores(model, T.Inputs(model), [text])[0] >= 0.7


def test_every_overlapping_window_is_listed():
    for sizes in ([], [0], [1], [15, 16, 17], [0, 40, 3, 0, 16, 1000, 1]):
        texts = [np.arange(1, n + 1, dtype=np.int32) + 10_000 * k for k, n in enumerate(sizes)]
        flat, starts, owner = T.window_table(texts)
        found = [(k, flat[s : s + T.WINDOW].tolist()) for s, k in zip(starts, owner, strict=True)]
        wanted = []
        for k, words in enumerate(texts):
            padded = words.tolist() + [0] * (T.WINDOW - len(words))
            wanted += [(k, padded[s : s + T.WINDOW]) for s in range(len(padded) - T.WINDOW + 1) if len(words)]
        assert found == wanted


def test_scores_equal_a_plain_reading_of_every_window(model):
    """One window after the other, word after word, by the equations of the network."""
    rng = random.Random(8)
    texts = [t for t, _ in corpus(rng, 12)] + ["", "stenk", "lo mi", " ".join(["ka"] * 16), " ".join(["mi"] * 17)]

    def soft(x):
        return x / (1 + np.abs(x))

    def plain(words):
        x = [T.Inputs(model).vectors_of([w])[0] if w else np.zeros(T.WORD_DIM + T.GRAM_DIM) for w in words]
        states = [[], []]
        for way in range(2):
            h = np.zeros(T.HIDDEN)
            for t in range(T.WINDOW) if way == 0 else reversed(range(T.WINDOW)):
                r0, z0, n0 = np.split(x[t] @ model["w"][way] + model["b"][way], 3)
                r1, z1, n1 = np.split(h @ model["u"][way], 3)
                r, z = 0.5 + 0.5 * soft(r0 + r1), 0.5 + 0.5 * soft(z0 + z1)
                h = (1 - z) * soft(n0 + r * n1) + z * h
                states[way].append(h)
        both = [np.concatenate(pair) for pair in zip(states[0], states[1][::-1], strict=True)]
        both = np.array([h for h, w in zip(both, words, strict=True) if w])
        share = np.exp(both @ model["attend"] - (both @ model["attend"]).max())
        return (share / share.sum()) @ both @ model["out"] + model["bias"][0]

    wanted = []
    for text in texts:
        words = text.split()
        padded = words + [None] * (T.WINDOW - len(words))
        logits = [plain(padded[s : s + T.WINDOW]) for s in range(len(padded) - T.WINDOW + 1)] if words else [model["bias"][0]]
        wanted.append(1 / (1 + np.exp(-max(logits))))
    found = T.scores(model, T.Inputs(model), texts)
    assert np.allclose(found, wanted, atol=1e-4)


def test_blocks_of_windows_do_not_change_scores(model, monkeypatch):
    texts = [t for t, _ in corpus(random.Random(9), 40)]
    one = T.scores(model, T.Inputs(model), texts)
    monkeypatch.setattr(T, "AT_ONCE", 37)
    assert np.allclose(one, T.scores(model, T.Inputs(model), texts), atol=1e-5)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    wide, places, count = T.WORD_DIM + T.GRAM_DIM, 5, 3
    model = {
        "w": rng.normal(0, 0.5, (2, wide, 3 * T.HIDDEN)), "u": rng.normal(0, 0.5, (2, T.HIDDEN, 3 * T.HIDDEN)),
        "b": rng.normal(0, 0.5, (2, 3 * T.HIDDEN)), "attend": rng.normal(0, 0.5, 2 * T.HIDDEN),
        "out": rng.normal(0, 0.5, 2 * T.HIDDEN), "bias": rng.normal(0, 0.5, 1),
    }
    x, label = rng.normal(0, 1, (places, count, wide)), np.array([1.0, 0.0, 1.0])
    real = np.arange(places)[:, None] < np.array([5, 3, 1])

    def loss():
        p = T.sigmoid(T.read(model, x, real).astype(np.float64))
        return -(label * np.log(p) + (1 - label) * np.log(1 - p)).mean()

    d, d_x = T.slopes(model, x, real, label)
    for values, slope in [*((model[k], d[k]) for k in model), (x, d_x)]:
        for at in rng.integers(0, values.size, 6):
            old = values.flat[at]
            values.flat[at] = old + 1e-3
            up = loss()
            values.flat[at] = old - 1e-3
            down = loss()
            values.flat[at] = old
            assert abs((up - down) / 2e-3 - slope.flat[at]) < 2e-3


def test_rows_and_labels(spark, make):
    rows = [(k, t) for k, (t, _) in enumerate(corpus(random.Random(4), 60))] + [(None, "x"), (1000, None), (3, "again"), (3, "again")]
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)] + [(None, 1, 1), (2, 1, None)], "doc_id long, quality int, toxic int")
    found = T.toxicity_scores(make(rows), labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert {r.score for r in T.toxicity_scores(make(rows), labels.limit(0)).collect()} == {0.0}
    assert T.toxicity_scores(make([]), labels).collect() == []


def test_repeated_ids_do_not_fill_the_sample(spark, make, monkeypatch):
    monkeypatch.setattr(T, "FIT_TOXIC", 3)
    monkeypatch.setattr(T, "FIT_CLEAN", 3)
    monkeypatch.setattr(T, "fit", lambda texts, label: (texts, label.tolist()))
    docs = make([(k, f"text {k}") for k in range(6)] * 5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)] * 9, "doc_id long, label int")
    texts, label = T.fit_on(docs, labels)
    assert texts == [f"text {k}" for k in range(6)] and label == [0, 1] * 3


def test_labels_of_held_out_rows_are_not_used(spark, make):
    import zlib

    rows = [(k, t) for k, (t, _) in enumerate(corpus(random.Random(5), 60))]
    kinds = "doc_id long, toxic int"
    one = spark.createDataFrame([(k, k % 2) for k in range(60)], kinds)
    two = spark.createDataFrame([(k, k % 2 if zlib.crc32(str(k).encode()) % 3 != 1 else 1 - k % 2) for k in range(60)], kinds)
    scores = [sorted((r.doc_id, r.score) for r in T.toxicity_scores(make(rows), x).collect()) for x in (one, two)]
    assert scores[0] == scores[1]


def test_a_fit_in_a_task_equals_one_here(spark, make):
    rows = corpus(random.Random(5), 60)
    docs = make([(k, text) for k, (text, _) in enumerate(rows)])
    labels = spark.createDataFrame([(k, label) for k, (_, label) in enumerate(rows)], "doc_id long, label int")
    here, there = T.fit_on(docs, labels), T.fit_in_task(docs, labels)
    assert here.keys() == there.keys() and all(np.array_equal(here[k], there[k]) for k in here)
    assert T.fit_in_task(docs, labels.limit(0)) is None and T.fit_in_task(docs, labels.where("label = 0")) is None
