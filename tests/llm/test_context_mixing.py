"""Scores against a plain reading, bit by bit, and counts against plain counting."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from duewatch.llm import context_mixing as cm
from duewatch.llm.context_mixing import Beginnings, Block, Code, Lanes, Model, Spelled, closed, outside, scores


def plain_words(text):
    return (text or "").encode().lower().split() + [b"\n"]


def made_texts(rng, n=40):
    bag = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(120)]
    return [" ".join(rng.choice(bag[: rng.randint(5, 120)]) for _ in range(rng.randint(0, 90))) for _ in range(n)]


def code_for(texts):
    data = np.frombuffer((" " + " ".join(texts)).encode(), np.uint8).astype(int)
    return Code(np.bincount(256 * data[:-1] + data[1:], minlength=1 << 16))


def bits_of(word, code):
    return [b for before, byte in zip(b" " + word, closed(word), strict=False) for b in code_of(code, before, byte)]


def code_of(code, before, byte):
    at = 256 * before + byte
    return tuple(code.bit[code.first[at] : code.first[at] + code.length[at]].tolist())


def test_code_is_a_prefix_code_in_order():
    rng = random.Random(0)
    code = Code(np.array([rng.randrange(10 ** rng.randrange(6)) for _ in range(512)] + [0] * (65536 - 512)))
    for before in (0, 1, 77):
        codes = {byte: code_of(code, before, byte) for byte in range(256)}
        assert math.isclose(sum(0.5 ** len(c) for c in codes.values()), 1)
        assert sorted(range(256), key=codes.get) == sorted(range(256), key=lambda b: code.rank[256 * before + b])
        assert len(set(codes.values())) == 256
    words = ["".join(rng.choice("abü") for _ in range(rng.randint(1, 6))).encode() for _ in range(200)]
    assert sorted(words, key=lambda w: bits_of(w, code)) == sorted(words, key=dict(zip(words, code.keys(words))).get)


def test_beginnings_over_ranges_equal_plain_counts():
    rng = random.Random(1)
    texts = made_texts(rng)
    code = code_for(texts)
    counts = Counter(w for t in texts for w in plain_words(t))
    counts[b"a" * 60], counts[b"a" * 61], counts[b"zz"] = 3, 4, 0
    plain = Counter()
    for word, n in counts.items():
        bits = bits_of(word, code)[: int(Spelled([word], code).known[0])]
        for k in range(len(bits) + 1):
            plain[tuple(bits[:k])] += n
    words = sorted(counts, key=lambda w: bits_of(w, code))
    for size in (1, 2, 3, 7, 50, 1000):
        parts = [words[low : low + size] for low in range(0, len(words), size)]
        rows, none = [], np.zeros(0, np.int64)
        for i, part in enumerate(parts):
            own = Spelled(part, code)
            sums = Beginnings(own, np.array([counts[w] for w in part]), none, none)
            ends = [own.bit[own.begin[k] : own.begin[k] + own.known[k]].tobytes() for k in (0, -1)]
            rows.append((i, *ends, sums.first, sums.last))
        borders = outside(rows)
        for i, part in enumerate(parts):
            own = Spelled(part, code)
            sums = Beginnings(own, np.array([counts[w] for w in part]), *borders[i])
            for word, begin, known in zip(part, own.begin, own.known, strict=True):
                bits = bits_of(word, code)
                assert sums.before[begin : begin + known].tolist() == [plain[tuple(bits[:k])] for k in range(known)]
                assert sums.after[begin : begin + known].tolist() == [plain[tuple(bits[: k + 1])] for k in range(known)]


def block_of(texts, code, rng, trained=None):
    counts = Counter(w for t in (trained or texts) for w in plain_words(t))
    words = sorted({w for t in texts for w in plain_words(t)} | set(counts), key=lambda w: bits_of(w, code))
    n = np.array([counts[w] for w in words])
    own, none = Spelled(words, code), np.zeros(0, np.int64)
    sums = Beginnings(own, n, none, none)
    tables = tuple(np.array([rng.randint(-40, 40) for _ in range(1 << s)], np.int8) for s in (cm.SLOTS2, cm.SLOTS4))
    weights = np.array([[rng.uniform(0, 0.6) for _ in range(3)] for _ in range(cm.GATES)])
    model = Model(code, tables, weights, int(n.sum()), int((n > 0).sum()))
    known = pa.array(cm.own_predictions(own, n, sums), pa.binary())
    return Block(model, pa.array(words, pa.binary()), n, known), words, own, sums, model


def plain_cost(numbers, words, own, sums, model):
    """One text read bit by bit: predictors, gate, mixing, map, and learning after every STEPS bits."""
    flat = [(i, k) for i in numbers for k in range(own.sizes[i])]
    slots, prefix = own.slots(), own.beginnings()
    total = 0.0
    for low in range(0, len(flat), cm.STRETCH):
        weights = {g: [1.0, cm.OWN_WEIGHT] for g in range(2 * cm.GATES)}
        columns = 2 * cm.MAP_HALF * cm.MAP_STEP + 1
        curve = {(g, c): 1 / (1 + math.exp(-(c / cm.MAP_STEP - cm.MAP_HALF))) for g in range(cm.GATES) for c in range(columns)}
        states = Counter()
        for begin in range(low, min(low + cm.STRETCH, len(flat)), cm.STEPS):
            moves, learned, mapped = [], {}, {}
            for i, k in flat[begin : min(begin + cm.STEPS, low + cm.STRETCH)]:
                at = int(own.begin[i] + k)
                bit, known = int(own.bit[at]), k < own.known[i]
                before, after = (int(s[at]) if known else 0 for s in (sums.before, sums.after))
                near = min(cm.SIZES, key=lambda v: abs(v - abs(math.log((after + 0.4) / (before - after + 0.4)))))
                trie = near * (1 if 2 * after >= before else -1) if before else 0
                gate = min(7, (before.bit_length() + 1) // 2)
                sign = 2 * bit - 1
                x = [int(t[s[at]]) * sign * cm.UNIT for t, s in zip(model.tables, slots, strict=True)] + [trie]
                z = sum(w * v for w, v in zip(model.weights[gate], x, strict=True))
                z = round(max(-cm.MOST_ODDS, min(cm.MOST_ODDS, z)) / cm.UNIT) * cm.UNIT
                slot = int(prefix[at]) & 0xFFFF
                slot >>= 16 - cm.OWN_SLOTS
                key = 2 * states[slot] + bit
                x = [z, float(cm.VALUE[key])]
                learned[slot] = int(cm.AFTER[key])
                g = 2 * gate + (states[slot] > 0)
                z = max(-cm.MOST_ODDS, min(cm.MOST_ODDS, sum(w * v for w, v in zip(weights[g], x, strict=True))))
                p = 1 / (1 + math.exp(-z))
                moves.append((g, [(1 - p) * cm.RATE * v for v in x]))
                c = int(max(0.0, min(columns - 0.5, (sign * z + cm.MAP_HALF) * cm.MAP_STEP + 0.5)))
                one = curve[gate, c]
                mapped[gate, c] = one + (bit - one) * cm.MAP_RATE
                total -= math.log2((p + (one if bit else 1 - one)) / 2)
            for g, step in moves:
                weights[g] = [w + s for w, s in zip(weights[g], step, strict=True)]
            states.update({s: v - states[s] for s, v in learned.items()})
            curve.update(mapped)
    return total


def test_reading_equals_a_plain_one(monkeypatch):
    monkeypatch.setattr(cm, "STRETCH", 512)
    monkeypatch.setattr(cm, "LANES", 7)
    rng = random.Random(2)
    texts = [*made_texts(rng, 12), "", "a" * 100 + " b"]
    code = code_for(texts)
    block, words, own, sums, model = block_of(texts, code, rng, trained=texts[:6])
    number = {w: i for i, w in enumerate(words)}
    numbers = [np.array([number[w] for w in plain_words(t)]) for t in texts]
    got = block.costs(numbers)
    for one, body in zip(got, numbers, strict=True):
        assert math.isclose(one, plain_cost(body.tolist(), words, own, sums, model), rel_tol=2e-4)
    alone = np.array([block.costs([body])[0] for body in numbers])
    assert np.allclose(alone, got, rtol=1e-6)


def test_learns_after_each_bit_to_the_end_of_a_text(monkeypatch):
    """The plain reading moves after every bit and never starts anew, with bits side by side and bits read alone."""
    rng = random.Random(5)
    texts = [" ".join(made_texts(rng, 60)), *made_texts(rng, 5)]
    code = code_for(texts)
    block, words, own, sums, model = block_of(texts, code, rng, trained=texts[1:])
    number = {w: i for i, w in enumerate(words)}
    numbers = [np.array([number[w] for w in plain_words(t)]) for t in texts]
    assert own.sizes[numbers[0]].sum() > 2 * 8192
    got = [block.costs(numbers)]
    monkeypatch.setattr(cm, "LONG", 300, raising=False)
    monkeypatch.setattr(cm, "PREPARED", 64, raising=False)
    got.append(block.costs(numbers))
    monkeypatch.setattr(cm, "STEPS", 1)
    monkeypatch.setattr(cm, "STRETCH", 1 << 40)
    plain = [plain_cost(body.tolist(), words, own, sums, model) for body in numbers]
    assert np.allclose(got[0], plain, rtol=2e-4) and np.allclose(got[1], plain, rtol=2e-4)


def test_long_texts_are_read_side_by_side(monkeypatch):
    """Only where few texts are as long are they read one at a time; reading by steps gives the same there."""
    rng = random.Random(6)
    texts = [" ".join(made_texts(rng, rng.randint(3, 9))) for _ in range(40)]
    code = code_for(texts)
    block, words, own, sums, model = block_of(texts, code, rng)
    number = {w: i for i, w in enumerate(words)}
    numbers = [np.array([number[w] for w in plain_words(t)]) for t in texts]
    monkeypatch.setattr(cm, "LONG", 500)
    one_by_one, seen = Lanes.alone, []
    monkeypatch.setattr(Lanes, "alone", lambda self, lane: seen.append(lane) or one_by_one(self, lane))
    got = block.costs(numbers)
    sizes = sorted(int(own.sizes[body].sum()) for body in numbers)
    assert sizes[0] > 500 and 0 < len(set(seen)) < cm.FEW and len(seen) < cm.FEW
    plain = [plain_cost(body.tolist(), words, own, sums, model) for body in numbers]
    assert np.allclose(got, plain, rtol=2e-4)


def test_sums_beside_a_word_equal_those_of_all_beginnings():
    rng = random.Random(7)
    texts = made_texts(rng)
    code = code_for(texts)
    counts = Counter(w for t in texts for w in plain_words(t))
    counts[b"a" * 60], counts[b"a" * 61], counts[b"a" * 24], counts[b"zz"] = 3, 4, 5, 0
    for _ in range(50):
        some = rng.sample(sorted(counts), rng.choice([1, 2, 5, 60]))
        table = pa.table({"word": pa.array(some, pa.binary()), "n": pa.array([counts[w] for w in some], pa.int64())})
        words, n = cm.in_order(table, code)
        assert words.to_pylist() == sorted(some, key=lambda w: bits_of(w, code))
        own, none = Spelled(words, code), np.zeros(0, np.int64)
        sums = Beginnings(own, n, none, none)
        for edge, plain in ((0, sums.first), (len(words) - 1, sums.last)):
            bits, found = cm.sums_beside(words, n, edge, code)
            assert found == plain and list(bits) == bits_of(words[edge].as_py(), code)[: own.known[edge]]


@pytest.mark.parametrize("size", [32 << 20, 700])
def test_texts_and_words_of_blocks(monkeypatch, size):
    """Blanks at both ends, other white space, null and empty texts, and blocks that end within a batch."""
    monkeypatch.setattr(cm, "BLOCK_BYTES", size)
    rng = random.Random(8)
    texts = [*made_texts(rng), None, "", " \t ", " A\x0b\x0cb\r\nB\t", "É é\x1cx\x85y a", "x\x00y", *made_texts(rng)]
    rows = pa.table({"doc_id": pa.array([*range(len(texts) - 1), None], pa.int64()), "text": pa.array(texts, pa.string())})
    found = pa.Table.from_batches(list(cm.read_rows(iter(rows.to_batches(max_chunksize=17)))))
    kind = found.column("kind").to_numpy()
    words = [r for r in found.filter(pa.array(kind == cm.WORD)).to_pylist()]
    name = {(r["block"], r["number"]): r["word"] for r in words}
    got, plain = [], Counter()
    for r in found.filter(pa.array(kind == cm.TEXT)).to_pylist():
        read = [name[r["block"], i] for i in cm.unpacked_numbers(r["body"]).tolist()]
        got.append((r["doc_id"], r["held_out"], read))
        if not r["held_out"]:
            plain.update((r["block"], w) for w in read)
    assert got == [(i, cm.is_held_out(i), plain_words(t)) for i, t in zip(rows.column("doc_id").to_pylist(), texts, strict=True)]
    assert {(r["block"], r["word"]): r["n"] for r in words if r["n"]} == dict(plain)
    assert (len({r["block"] for r in words}) > 5) == (size == 700)


def test_both_bits_share_all_probability():
    """Whatever was read before, the probabilities of a zero and a one add up to one."""
    rng = np.random.default_rng(3)
    for _ in range(5):
        past = rng.normal(0, 2, (6, 96)).astype(np.float32)
        bit, gate = rng.integers(0, 2, (6, 96)).astype(np.uint8), rng.integers(0, cm.GATES, (6, 96))
        slot = rng.integers(0, 40, (6, 96))
        last = []
        for flip in (0, 1):
            lanes = Lanes(6)
            for low in range(0, 96, cm.STEPS):
                part = slice(low, low + cm.STEPS)
                signed = past[:, part].copy()
                own = bit[:, part].copy()
                if low + cm.STEPS == 96 and flip:
                    own[:, -1] ^= 1
                    signed[:, -1] *= -1
                p = lanes.read(signed, own, gate[:, part], slot[:, part])
            last.append(p[:, -1])
        assert np.allclose(last[0] + last[1], 1, atol=1e-5)


def documents(spark, rows, parts=3):
    full = [(*r, "w", 5, "b") for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, word string, n int, block string").repartition(parts)


def base_of(rows):
    counts, out = Counter(), []
    for doc_id, text in rows:
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10:
            counts.update(plain_words(text))
    total = sum(counts.values())
    for doc_id, text in rows:
        held = doc_id is None or zlib.crc32(str(doc_id).encode()) % 10 == 0
        words = plain_words(text)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (len(counts) + 1))) for w in words)
        out.append((doc_id, held, len(words), sum(counts[w] > 0 for w in words), total, base))
    return out


@pytest.mark.parametrize("block,ranges", [(32 << 20, 50_000), (3000, 15)])
def test_documents(spark, monkeypatch, block, ranges):
    monkeypatch.setattr(cm, "RANGE_WORDS", ranges)
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(made_texts(rng, 80))]
    rows += [(None, "abc abc"), (3, None), (4, ""), (5, " \t"), rows[6], (None, None), (901, "Ünique x" * 3000)]
    got = scores(documents(spark, rows)).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    for ours, plain in zip(sorted(got, key=key), sorted(base_of(rows), key=key), strict=True):
        assert tuple(ours)[:5] == plain[:5]
        assert math.isclose(ours.base_score, plain[5], rel_tol=1e-9, abs_tol=1e-9)
        assert ours.score < 0 and math.isclose(ours.bits_per_byte * ours.text_bytes * math.log10(2), -ours.score, rel_tol=1e-9)
    again = {(r.doc_id, r.n_tokens, round(r.score, 3)) for r in scores(documents(spark, rows, 1)).collect()}
    assert again == {(r.doc_id, r.n_tokens, round(r.score, 3)) for r in got}


def test_held_out_texts_cost_less_than_by_words_alone(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = [r for r in scores(docs).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_no_training_texts_and_no_texts(spark):
    held_out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = scores(documents(spark, [(held_out, "ab ab")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (3, 0, 0, 0.0) and row.score < 0
    assert scores(documents(spark, [(1, "a")]).limit(0)).collect() == []
