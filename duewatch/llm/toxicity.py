"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A word enters as its hashed word embedding next to the mean of its hashed character n-gram embeddings, so inflections of
a known root are read too. Both tables start from the label odds in the training rows and are trained with the network,
by back-propagation in numpy. Gates and states bend by ``x / (1 + |x|)``, faster than the hyperbolic tangent. A text is scored in all overlapping windows of ``WINDOW`` words, one from each word on; its
score is the highest of its windows. While training, the window of a toxic text that scores highest carries the label,
and clean texts give random windows, the ones that score highest by mistake, and windows of one word of theirs repeated.

The fit uses at most ``FIT_TOXIC`` toxic and ``FIT_CLEAN`` clean labelled ids, taken in the order of a hash of the id,
and one text of each, the smallest. It runs in one task, which that bound keeps small.
Scoring reads every word of every text. Null and empty texts get the score of no window, the network's bias. Without
rows of both labels every score is 0. Repeated rows each get a result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shingles import mix

#: The bound of the labelled sample that the network is fitted on.
FIT_TOXIC, FIT_CLEAN = 700, 2500
WINDOW = 16
WORD_ROWS, GRAM_ROWS = 1 << 16, 1 << 18
WORD_DIM, GRAM_DIM, HIDDEN = 4, 4, 8
GRAMS = (3, 4, 5)
ROUNDS, BATCH = 6, 128
#: Windows of a single repeated word among the training windows.
ECHOES = 3000
#: Words whose inputs a task keeps; only bounds its memory.
KEPT_WORDS = 250_000
#: Windows read at a time; only bounds memory.
AT_ONCE = 4096
EDGE = ".,;:!?\"'()[]{}|*#$%&<>=+-_/\\~`"


def words_of(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def gram_rows(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words of like length: their places in the list, the table rows of their n-grams, and which of these exist."""
    coded = [b"^" + word.encode("utf-8", "replace") + b"$" for word in words]
    size = np.array([len(x) for x in coded])
    wide = -(-size // 4)
    for kind in np.unique(wide):
        chosen = np.flatnonzero(wide == kind)
        width = int(kind) * 4
        step = max(1, 200_000 // width)
        for at in range(0, len(chosen), step):
            part = chosen[at : at + step]
            letters = np.frombuffer(b"".join(coded[i].ljust(width, b"\0") for i in part.tolist()), np.uint8)
            letters = letters.reshape(len(part), width).astype(np.uint64)
            rows, real = [], []
            for n in (n for n in GRAMS if n <= width):
                code = np.full((len(part), width - n + 1), n, np.uint64)
                for k in range(n):
                    code = code * np.uint64(0x100000001B3) + letters[:, k : width - n + 1 + k]
                rows.append((mix(code) % np.uint64(GRAM_ROWS)).astype(np.int32))
                real.append(np.arange(width - n + 1) <= size[part, None] - n)
            yield part, np.concatenate(rows, axis=1), np.concatenate(real, axis=1)


def word_rows(words: list[str]) -> np.ndarray:
    """Table rows of whole words."""
    out = np.zeros(len(words), np.int64)
    by_letters = np.zeros(len(words), np.uint64)
    coded = [word.encode("utf-8", "replace") for word in words]
    size = np.array([len(x) for x in coded], np.int64)
    if len(words):
        data = np.frombuffer(b"".join(coded) or b"\0", np.uint8).astype(np.uint64)
        ends = np.cumsum(size)
        place = np.arange(len(data)) - np.repeat(ends - size, size) if ends[-1] else np.zeros(1, np.int64)
        code = mix((data << np.uint64(32)) + place.astype(np.uint64))
        total = np.concatenate([[np.uint64(0)], np.cumsum(code, dtype=np.uint64)])
        by_letters = total[ends] - total[ends - size]
        out = (mix(by_letters) % np.uint64(WORD_ROWS)).astype(np.int64)
    return out


def bare(word: str) -> str:
    return word.strip(EDGE) or word


class Numbering(dict):
    """Numbers words from 1 as they come; ``fresh`` gathers the new ones."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self) + 1
        self.fresh.append(word)
        return found

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


class Inputs:
    """Keeps the input vectors of the words met so far."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.model = model
        self.grams = np.concatenate([model["gram"], np.zeros((1, GRAM_DIM), np.float32)])
        self.number = Numbering()
        self.vectors = np.zeros((KEPT_WORDS // 4, WORD_DIM + GRAM_DIM), np.float32)

    def numbers(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.number) > KEPT_WORDS:
            self.number = Numbering()
        out = [self.number.of(text) for text in texts]
        fresh, self.number.fresh = self.number.fresh, []
        if fresh:
            end = len(self.number) + 1
            if end > len(self.vectors):
                self.vectors = np.resize(self.vectors, (2 * end, self.vectors.shape[1]))
            self.vectors[end - len(fresh) : end] = self.vectors_of(fresh)
        return out

    def vectors_of(self, words: list[str]) -> np.ndarray:
        words = [bare(word) for word in words]
        out = np.zeros((len(words), WORD_DIM + GRAM_DIM), np.float32)
        out[:, :WORD_DIM] = self.model["word"][word_rows(words)]
        for part, rows, real in gram_rows(words):
            rows[~real] = GRAM_ROWS
            out[part, WORD_DIM:] = self.grams[rows].sum(axis=1) / np.maximum(real.sum(axis=1), 1)[:, None]
        return out


def window_table(numbers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts in one row, each filled up to a window (0: none); starts of all windows of a text, and the text."""
    flat = [np.pad(x, (0, max(0, WINDOW - len(x)))) for x in numbers if len(x)]
    flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
    length = np.array([len(x) for x in numbers], np.int64)
    held = np.where(length > 0, np.maximum(length, WINDOW), 0)
    count = np.where(length > 0, held - WINDOW + 1, 0)
    owner = np.repeat(np.arange(len(numbers)), count)
    starts = np.arange(count.sum()) + np.repeat(np.cumsum(held) - held - np.cumsum(count) + count, count)
    return flat, starts, owner


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * 0.5) * 0.5 + 0.5


def bend(x: np.ndarray, room: np.ndarray | None = None) -> np.ndarray:
    """``x / (1 + |x|)``, in place; its slope is ``(1 - |bend(x)|) ** 2``."""
    room = np.abs(x, out=room)
    room += 1
    x /= room
    return x


def read(model: dict[str, np.ndarray], x: np.ndarray, real: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Logits of windows. ``x``: (place, window, input); ``real``: (place, window). ``keep`` gets what training needs."""
    places, count = real.shape
    states = np.empty((places, count, 2 * HIDDEN), np.float32)
    for way in range(2):
        pre = x @ model["w"][way] + model["b"][way]
        u = model["u"][way]
        h = np.zeros((count, HIDDEN), np.float32)
        for t in range(places) if way == 0 else range(places - 1, -1, -1):
            hu = h @ u
            gates = pre[t, :, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN]
            bend(gates)
            gates *= 0.5
            gates += 0.5
            r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
            n = r * hu[:, 2 * HIDDEN :]
            n += pre[t, :, 2 * HIDDEN :]
            bend(n)
            new = h - n
            new *= z
            new += n
            if keep is not None:
                keep.append((way, t, h, r, z, n, hu[:, 2 * HIDDEN :]))
            h = new
            states[t, :, way * HIDDEN : (way + 1) * HIDDEN] = h
    weight = np.where(real, states @ model["attend"], -1e9)
    weight = np.exp(weight - weight.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    if keep is not None:
        keep.append((states, weight, pooled))
    return pooled @ model["out"] + model["bias"][0]


def slopes(model: dict[str, np.ndarray], x: np.ndarray, real: np.ndarray, label: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the mean log loss, and those of the inputs."""
    keep: list = []
    logit = read(model, x, real, keep)
    states, weight, pooled = keep.pop()
    d_logit = ((sigmoid(logit) - label) / len(label)).astype(np.float32)
    d = {k: np.zeros_like(v) for k, v in model.items() if k not in ("word", "gram")}
    d["out"], d["bias"] = pooled.T @ d_logit, d_logit.sum(keepdims=True)
    d_pooled = d_logit[:, None] * model["out"]
    d_weight = (states * d_pooled).sum(axis=2)
    d_score = weight * (d_weight - (weight * d_weight).sum(axis=0))
    d["attend"] = np.einsum("tbh,tb->h", states, d_score)
    d_states = weight[:, :, None] * d_pooled + d_score[:, :, None] * model["attend"]
    d_x = np.zeros_like(x)
    d_h: dict[int, np.ndarray] = {}
    for way, t, h, r, z, n, hn in reversed(keep):
        u = model["u"][way]
        dh = d_states[t, :, way * HIDDEN : (way + 1) * HIDDEN] + d_h.get(way, 0)
        dn = dh * (1 - z) * (1 - np.abs(n)) ** 2
        dz = dh * (h - n) * 0.5 * (1 - np.abs(2 * z - 1)) ** 2
        dr = dn * hn * 0.5 * (1 - np.abs(2 * r - 1)) ** 2
        d_pre = np.concatenate([dr, dz, dn], axis=1)
        d_hu = np.concatenate([dr, dz, dn * r], axis=1)
        d_h[way] = dh * z + d_hu @ u.T
        d["u"][way] += h.T @ d_hu
        d["w"][way] += x[t].T @ d_pre
        d["b"][way] += d_pre.sum(axis=0)
        d_x[t] += d_pre @ model["w"][way].T
    return d, d_x


def odds(rows: Iterable[np.ndarray], label: np.ndarray, size: int) -> np.ndarray:
    """How far each table row's share of toxic texts stands out; 0 for rows met in fewer than three of them."""
    counts = np.zeros((2, size))
    for k, found in enumerate(rows):
        counts[label[k], np.unique(found)] += 1
    clean, toxic = counts
    gap = np.log((toxic + 0.5) / (label.sum() + 1)) - np.log((clean + 0.5) / (len(label) - label.sum() + 1))
    return np.where(toxic >= 3, gap / np.sqrt(1 + 1 / (toxic + 0.5)), 0.0)


def fit(texts: list[str | None], label: np.ndarray, seed: int = 7) -> dict[str, np.ndarray] | None:
    """The network's weights, or None without texts of both labels."""
    label = np.asarray(label, np.int64)
    if label.min(initial=1) == label.max(initial=0) or len(label) == 0:
        return None
    rng = np.random.default_rng(seed)
    wide = WORD_DIM + GRAM_DIM
    model = {
        "word": rng.normal(0, 0.02, (WORD_ROWS, WORD_DIM)).astype(np.float32),
        "gram": rng.normal(0, 0.02, (GRAM_ROWS, GRAM_DIM)).astype(np.float32),
        "w": rng.normal(0, 0.4, (2, wide, 3 * HIDDEN)).astype(np.float32),
        "u": rng.normal(0, 0.25, (2, HIDDEN, 3 * HIDDEN)).astype(np.float32),
        "b": np.zeros((2, 3 * HIDDEN), np.float32),
        "attend": rng.normal(0, 0.5, 2 * HIDDEN).astype(np.float32),
        "out": rng.normal(0, 0.5, 2 * HIDDEN).astype(np.float32),
        "bias": np.full(1, -1.0, np.float32),
    }
    numbering = Numbering()
    numbers = [numbering.of(text) for text in texts]
    known = [bare(word) for word in numbering.fresh]
    whole = np.concatenate([[0], word_rows(known)]).astype(np.int64)
    owners, flat = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for part, rows, real in gram_rows(known):
        owners.append(np.repeat(part + 1, real.sum(axis=1)).astype(np.int32))
        flat.append(rows[real])
    by_word = np.concatenate(owners)
    gram_flat = np.concatenate(flat)[np.argsort(by_word, kind="stable")]
    gram_count = np.bincount(by_word, minlength=len(known) + 1)
    gram_start = np.cumsum(gram_count) - gram_count
    del owners, flat, by_word

    def grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table rows of the n-grams of these words, and the word that each belongs to."""
        count = gram_count[words]
        at = np.arange(count.sum()) + np.repeat(gram_start[words] - (np.cumsum(count) - count), count)
        return gram_flat[at], np.repeat(np.arange(len(words)), count)

    distinct = [np.unique(found) for found in numbers]
    model["word"][:, 0] += odds((whole[found] for found in distinct), label, WORD_ROWS) * 0.5
    model["gram"][:, 0] += odds((grams(found)[0] for found in distinct), label, GRAM_ROWS)

    def vectors(words: np.ndarray) -> np.ndarray:
        out = np.zeros((len(words), wide), np.float32)
        out[:, :WORD_DIM] = model["word"][whole[words]]
        for low in range(0, len(words), 20_000):
            part = words[low : low + 20_000]
            rows, owner = grams(part)
            total = np.zeros((len(part), GRAM_DIM), np.float32)
            for k in range(GRAM_DIM):
                total[:, k] = np.bincount(owner, model["gram"][rows, k], len(part))
            out[low : low + 20_000, WORD_DIM:] = total / np.maximum(gram_count[part], 1)[:, None]
        out[words == 0] = 0
        return out

    flat, starts, owner = window_table(numbers)
    # Some texts repeat one word; whatever clean texts say stays clean when repeated.
    said = np.unique(np.concatenate([found for found, kind in zip(distinct, label, strict=True) if kind == 0]))
    echo = np.repeat(rng.choice(said, min(len(said), ECHOES), replace=False)[:, None], WINDOW, axis=1)
    starts = np.concatenate([starts, len(flat) + np.arange(len(echo)) * WINDOW])
    flat = np.concatenate([flat, echo.ravel()]).astype(np.int32)
    owner = np.concatenate([owner, len(label) + np.arange(len(echo))])
    toxic_window = np.concatenate([label, np.zeros(len(echo), np.int64)])[owner] == 1
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.items() if k not in ("word", "gram")}
    squares = {k: np.full(len(model[k]), 1e-6, np.float32) for k in ("word", "gram")}
    steps = 0
    for _ in range(ROUNDS):
        score = read_all(model, vectors(np.arange(len(known) + 1)), flat)[starts]
        order = np.lexsort((-score, owner))
        first = np.ones(len(order), bool)
        first[1:] = owner[order][1:] != owner[order][:-1]
        best = order[first]
        positive = best[toxic_window[best]]
        clean = np.flatnonzero(~toxic_window)
        hard = best[~toxic_window[best]]
        hard = hard[np.argsort(-score[hard], kind="stable")[: 2 * len(positive)]]
        random = rng.choice(clean, min(len(clean), 4 * len(positive) + 64), replace=False)
        chosen = np.unique(np.concatenate([hard, random]))
        chosen = np.concatenate([positive, chosen])
        for _ in range(max(1, 300 // max(1, len(positive)))):
            rng.shuffle(chosen)
            for low in range(0, len(chosen), BATCH):
                part = chosen[low : low + BATCH]
                read_words = flat[starts[part, None] + np.arange(WINDOW)]
                used, place = np.unique(read_words, return_inverse=True)
                x = vectors(used)[place.reshape(len(part), WINDOW)].transpose(1, 0, 2).copy()
                real = read_words.T > 0
                d, d_x = slopes(model, x, real, toxic_window[part].astype(np.float32))
                steps += 1
                for k, g in d.items():
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    model[k] -= 0.02 * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-6)
                d_word = np.zeros((len(used), wide), np.float32)
                np.add.at(d_word, place.reshape(len(part), WINDOW).T, d_x)
                d_word[used == 0] = 0
                rows, of = grams(used)
                share = d_word[of, WORD_DIM:] / np.maximum(gram_count[used], 1)[of, None]
                for name, at, g in (("word", whole[used], d_word[:, :WORD_DIM]), ("gram", rows, share)):
                    some, back = np.unique(at, return_inverse=True)
                    total = np.zeros((len(some), g.shape[1]), np.float32)
                    np.add.at(total, back, g)
                    squares[name][some] += (total * total).mean(axis=1)
                    model[name][some] -= 0.02 * total / np.sqrt(squares[name][some])[:, None]
    return model


def read_all(model: dict[str, np.ndarray], vectors: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Logits of the windows that start at each place of a row of words, as :func:`read` gives them.

    Windows lie along the last axis, so a step over all of them reads one slice of the words' inputs. A state is only kept
    as its share of the attention and of the output. The gates' own halves move into the weights and the last step.
    """
    half = np.repeat(np.float32([1, 1, 0.5]), HIDDEN)[:, None]
    # Below the gates' rows: what a state adds to the attention and to the output.
    ends = [np.stack([model["attend"], model["out"]])[:, way * HIDDEN : (way + 1) * HIDDEN] for way in range(2)]
    turn = [np.concatenate([model["u"][way].T * half, ends[way]]).astype(np.float32) for way in range(2)]
    out = np.empty(max(0, len(flat) - WINDOW + 1), np.float32)
    for low in range(0, len(out), AT_ONCE):
        words = flat[low : low + AT_ONCE + WINDOW - 1]
        count = len(words) - WINDOW + 1
        x = vectors[words]
        told = np.zeros((WINDOW, 2, count), np.float32)
        hu, new = np.empty((3 * HIDDEN + 2, count), np.float32), np.empty((HIDDEN, count), np.float32)
        gates, n = np.empty((2 * HIDDEN, count), np.float32), np.empty((HIDDEN, count), np.float32)
        room = np.empty_like(gates)
        for way in range(2):
            pre = np.ascontiguousarray((x @ model["w"][way] + model["b"][way]).T)
            h = np.zeros((HIDDEN, count), np.float32)
            last = None
            for t in range(WINDOW) if way == 0 else range(WINDOW - 1, -1, -1):
                np.matmul(turn[way], h, out=hu)
                if last is not None:
                    told[last] += hu[3 * HIDDEN :]
                here = pre[:, t : t + count]
                np.add(hu[: 2 * HIDDEN], here[: 2 * HIDDEN], out=gates)
                bend(gates, room)
                hn = hu[2 * HIDDEN : 3 * HIDDEN]
                np.multiply(gates[:HIDDEN], hn, out=n)
                n += hn
                n += here[2 * HIDDEN :]
                bend(n, room[:HIDDEN])
                np.subtract(h, n, out=new)
                new *= gates[HIDDEN:]
                h += n
                h += new
                h *= 0.5
                last = t
            told[last] += ends[way] @ h
        weight = told[:, 0]
        weight[np.lib.stride_tricks.sliding_window_view(words, count) == 0] = -1e9
        weight = np.exp(weight - weight.max(axis=0))
        out[low : low + count] = (weight * told[:, 1]).sum(axis=0) / weight.sum(axis=0) + model["bias"][0]
    return out


def scores(model: dict[str, np.ndarray] | None, inputs: Inputs | None, texts: list[str | None]) -> np.ndarray:
    """The highest window of each text."""
    if model is None:
        return np.zeros(len(texts))
    best = np.full(len(texts), -np.inf)
    flat, starts, owner = window_table(inputs.numbers(texts))
    np.maximum.at(best, owner, read_all(model, inputs.vectors, flat)[starts])
    best[np.isinf(best)] = model["bias"][0]
    return 1 / (1 + np.exp(-np.clip(best, -500, 500)))


def scorer(model: dict[str, np.ndarray] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A mapper that puts ``score`` behind the columns of each batch; ``text`` is scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = Inputs(model) if model is not None else None
        for batch in batches:
            found = [
                scores(model, inputs, batch.column("text").slice(low, 256).to_pylist())
                for low in range(0, batch.num_rows, 256)
            ]
            rest = [name for name in batch.schema.names if name != "text"]
            found = pa.array(np.concatenate(found) if found else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in rest), found], [*rest, "score"])

    return run


def fit_sample(rows: list[dict]) -> dict[str, np.ndarray] | None:
    rows = sorted(rows, key=lambda row: (row["doc_id"], row["text"] or ""))
    return fit([row["text"] for row in rows], np.array([row["label"] for row in rows], np.int64))


def fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole sample to the fitted weights ``(name, shape, weights)``; none without both labels."""
    model = fit_sample([row for batch in batches for row in batch.to_pylist()])
    for name, value in (model or {}).items():
        columns = [pa.array([name]), pa.array([list(value.shape)], pa.list_(pa.int64())), pa.array([value.tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["name", "shape", "weights"])


def sample_of(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The bounded sample ``(doc_id, label, text)`` of ``labels(doc_id, label)`` joined to ``documents(doc_id, text)``."""
    sample = None
    for kind, bound in ((1, FIT_TOXIC), (0, FIT_CLEAN)):
        part = labels.where((F.col("label") == kind) & F.col("doc_id").isNotNull())
        part = part.select("doc_id", "label").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        sample = part if sample is None else sample.unionByName(part)
    of = {row["doc_id"]: row["label"] for row in sample.select("doc_id", "label").collect()}
    rows = documents.where(F.col("doc_id").isin(list(of))) if of else documents.limit(0)
    rows = rows.groupBy("doc_id").agg(F.min(F.col("text").cast("string")).alias("text"))
    toxic = F.col("doc_id").isin([doc_id for doc_id, label in of.items() if label])
    return rows.select("doc_id", toxic.cast("int").alias("label"), "text")


def fit_on(documents: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | None:
    """Fit on the sample here, in the calling process."""
    return fit_sample([row.asDict() for row in sample_of(documents, labels).collect()])


def fit_in_task(documents: DataFrame, labels: DataFrame) -> dict[str, np.ndarray] | None:
    """Fit on the sample in one task: the driver gets the sample's ids and the weights, not the texts."""
    sample = sample_of(documents, labels).repartition(1)
    fitted = sample.mapInArrow(fit_rows, "name string, shape array<long>, weights binary").collect()
    return {row["name"]: np.frombuffer(row["weights"], np.float32).reshape(row["shape"]) for row in fitted} or None


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def toxicity_scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, held_out, score)`` for every row; learns from rows of ``labels(doc_id, toxic)`` not held out."""
    usable = labels.where(~held_out() & F.col("toxic").isNotNull())
    model = fit_in_task(documents, usable.select("doc_id", F.col("toxic").cast("int").alias("label")))
    rows = documents.select("doc_id", held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scorer(model), f"doc_id {kind}, held_out boolean, score double")


def below_score(documents: DataFrame, labels: DataFrame, limit: float) -> DataFrame:
    """The whole rows that score below ``limit``."""
    usable = labels.where(~held_out() & F.col("toxic").isNotNull())
    model = fit_in_task(documents, usable.select("doc_id", F.col("toxic").cast("int").alias("label")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = Inputs(model) if model is not None else None
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = scores(model, inputs, part.column("text").to_pylist())
                yield part.filter(pa.array(found < limit))

    return documents.mapInArrow(run, documents.schema)
