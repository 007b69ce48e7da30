"""Toxicity by bags of subword embeddings (operator 9).

A word's vector is the mean of the vectors of its character n-grams (3 to 5 characters of ``<word>``) and of the word
itself, all hashed into one table.  A window's vector is the mean of its words' vectors, and a linear softmax over the two
classes reads it.  Embeddings and softmax are trained jointly in NumPy.  A document is as toxic as its worst window: the
first passes train on all windows with their document's label, the later ones on each document's worst window only.  A
one-dimensional logistic fit on training rows spared for it turns worst-window logits into probabilities.

Training takes a bounded sample of labelled rows (``per_class`` documents of each class, those of the smallest key hashes)
on the driver; scoring is one pass over all rows, and each worker keeps the numbers of the words that it has met.

Null and empty texts, and texts without words, score as a window whose words say nothing.  Without labels of both classes
every document scores 0.0.  Several labels of one document: the larger counts.  Null labels and keys are not learnt from.
Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, kept

WORD = re.compile(r"[^\W_]+")
KEPT_WORDS = 250_000
LONGEST = 40


def word_list(text: str | None) -> list[str]:
    """Runs of letters and digits; longer ones than LONGEST as pieces that overlap by what the longest n-gram needs."""
    words = WORD.findall((text or "").lower())
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[i : i + LONGEST] for w in words for i in range(0, max(1, len(w) - 4), LONGEST - 4)]


def subwords(word: str, buckets: int) -> list[int]:
    marked = f"<{word}>"
    grams = [marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(g.encode()) % buckets for g in (*grams, f"={word}")]


def window_starts(n: int, size: int, stride: int) -> list[int]:
    return list(range(0, max(1, n - size + stride), stride)) if n else []


def _softmax_margin(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Trainer:
    """Training texts as windows over a list of distinct words, each a list of table rows."""

    def __init__(self, texts: list[str], labels: np.ndarray, buckets: int, dim: int, size: int, stride: int, seed: int):
        index: dict[str, int] = {}
        words, starts, owner = [], [], []
        for d, text in enumerate(texts):
            own = [index.setdefault(w, len(index)) for w in word_list(text)]
            for s in window_starts(len(own), size, stride):
                starts.append(len(words))
                owner.append(d)
                words += own[s : s + size]
        self.words, self.starts, self.owner = np.array(words, np.int32), np.array([*starts, len(words)]), np.array(owner, np.int64)
        grams = [subwords(w, buckets) for w in index]
        self.gram_starts = np.concatenate([[0], np.cumsum([len(g) for g in grams], dtype=np.int64)]).astype(np.int64)
        self.grams = np.fromiter((g for x in grams for g in x), np.int32, int(self.gram_starts[-1]))
        self.labels, self.rng = labels.astype(np.float32), np.random.default_rng(seed)
        self.table = self.rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
        self.softmax = self.rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.moment = [np.full((buckets, 1), 1e-6, np.float32), np.full((dim, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)]

    def _flat(self, starts: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the runs picked, one after another, and each run's length."""
        sizes = starts[pick + 1] - starts[pick]
        ends = np.cumsum(sizes)
        return np.arange(ends[-1]) + np.repeat(starts[pick] - (ends - sizes), sizes), sizes

    def step(self, windows: np.ndarray, weight: np.ndarray, rate: float) -> None:
        """One AdaGrad step on the weighted log-loss of some windows, for table, softmax and bias together."""
        at, sizes = self._flat(self.starts, windows)
        used, where = np.unique(self.words[at], return_inverse=True)
        g, grams = self._flat(self.gram_starts, used.astype(np.int64))
        rows, place = np.unique(self.grams[g], return_inverse=True)
        cut = np.concatenate([[0], np.cumsum(grams)[:-1]])
        vectors = np.add.reduceat(self.table[rows][place], cut, axis=0) / grams[:, None]
        bag = np.add.reduceat(vectors[where], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0) / sizes[:, None]
        z = bag @ self.softmax + self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        y = self.labels[self.owner[windows]]
        loss = (p - np.stack([1 - y, y], 1)) * (weight / weight.sum())[:, None]
        to_bag = (loss @ self.softmax.T) / sizes[:, None]
        spread = np.repeat(to_bag, sizes, axis=0)
        to_word = np.stack([np.bincount(where, spread[:, k], len(used)) for k in range(spread.shape[1])], 1) / grams[:, None]
        spread = np.repeat(to_word, grams, axis=0)
        to_rows = np.stack([np.bincount(place, spread[:, k], len(rows)) for k in range(spread.shape[1])], 1).astype(np.float32)
        self.moment[0][rows] += (to_rows**2).mean(1, keepdims=True)
        self.table[rows] -= rate * to_rows / np.sqrt(self.moment[0][rows])
        for k, (value, grad) in enumerate(((self.softmax, bag.T @ loss), (self.bias, loss.sum(0))), 1):
            self.moment[k] += grad**2
            value -= rate * grad / np.sqrt(self.moment[k])

    def margins(self) -> np.ndarray:
        """The toxic class's logit less the other's, for every window."""
        number = self.table @ (self.softmax[:, 1] - self.softmax[:, 0])
        word = np.add.reduceat(number[self.grams], self.gram_starts[:-1]) / np.diff(self.gram_starts)
        mean = np.add.reduceat(word[self.words], self.starts[:-1]) / np.diff(self.starts)
        return mean + (self.bias[1] - self.bias[0])

    def worst(self) -> np.ndarray:
        """The window of the largest margin of each document that has one."""
        order = np.lexsort((-self.margins(), self.owner))
        first = np.concatenate([[True], np.diff(self.owner[order]) > 0])
        return order[first]

    def fit(self, passes: int, worst_passes: int, batch: int, rate: float) -> None:
        balance = np.where(self.labels > 0, 0.5 / max(1, self.labels.sum()), 0.5 / max(1, (1 - self.labels).sum()))
        per_document = np.bincount(self.owner, minlength=len(self.labels))
        for k in range(passes + worst_passes):
            pick = np.arange(len(self.owner)) if k < passes else self.worst()
            weight = balance[self.owner] / np.sqrt(per_document[self.owner]) if k < passes else balance[self.owner]
            pick = self.rng.permutation(pick)
            for i in range(0, len(pick), batch):
                part = pick[i : i + batch]
                self.step(part, weight[part], rate)


def logistic_fit(z: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Slope and offset of the probability of y given z, by Newton's method with a small ridge."""
    center, scale = z.mean(), z.std() + 1e-9
    x = np.stack([(z - center) / scale, np.ones_like(z)], 1).astype(np.float64)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = _softmax_margin(x @ w)
        ridge = np.array([1e-1, 1e-3])
        hessian = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        w = w + np.clip(np.linalg.solve(hessian, x.T @ (y - p) - ridge * w), -5, 5)
    return float(w[0] / scale), float(w[1] - w[0] * center / scale)


class ToxicityModel:
    """What scoring needs: one number per table row, the bias, the windows and the final fit."""

    def __init__(self, number: np.ndarray, bias: float, slope: float, offset: float, size: int, stride: int):
        self.number, self.bias, self.slope, self.offset, self.size, self.stride = number, bias, slope, offset, size, stride

    def margin(self, text: str | None, words: WordNumbers) -> float:
        """The logit of the worst window."""
        z = np.fromiter(map(words.__getitem__, word_list(text)), np.float64)
        if not len(z):
            worst = 0.0
        else:
            total = np.concatenate([[0.0], np.cumsum(z)])
            at = np.array(window_starts(len(z), self.size, self.stride))
            end = np.minimum(at + self.size, len(z))
            worst = float(((total[end] - total[at]) / (end - at)).max())
        return worst + self.bias

    def score(self, text: str | None, words: WordNumbers) -> float:
        return float(_softmax_margin(np.float64(self.slope * self.margin(text, words) + self.offset)))


class WordNumbers(dict):
    """word -> mean of its table rows' numbers, computed when first asked for."""

    def __init__(self, model: ToxicityModel):
        self.number, self.buckets = model.number.tolist(), len(model.number)

    def __missing__(self, word: str) -> float:
        rows = subwords(word, self.buckets)
        number = self.number
        value = sum(number[r] for r in rows) / len(rows)
        if len(self) < KEPT_WORDS:
            self[word] = value
        return value


def train(texts: list[str], labels: np.ndarray, buckets: int = 1 << 16, dim: int = 8, size: int = 8, stride: int = 4, passes: int = 1, worst_passes: int = 8, rate: float = 0.2, calibration: float = 0.2, seed: int = 7) -> ToxicityModel | None:
    """A model, or None if a class has no texts with words."""
    has_words = np.array([bool(WORD.search(t or "")) for t in texts], bool)
    texts, labels = [t for t, ok in zip(texts, has_words, strict=True) if ok], np.asarray(labels, np.float64)[has_words]
    if not (0 < labels.sum() < len(labels)):
        return None
    spared = np.random.default_rng(seed).random(len(texts)) < calibration
    if len({*labels[spared]}) < 2 or len({*labels[~spared]}) < 2:
        spared[:] = False
    t = Trainer([x for x, s in zip(texts, spared, strict=True) if not s], labels[~spared], buckets, dim, size, stride, seed)
    t.fit(passes, worst_passes, 256, rate)
    model = ToxicityModel((t.table @ (t.softmax[:, 1] - t.softmax[:, 0])).astype(np.float32), float(t.bias[1] - t.bias[0]), 1.0, 0.0, size, stride)
    fitted = spared if spared.any() else ~spared
    words = WordNumbers(model)
    margins = np.array([model.margin(x, words) for x, f in zip(texts, fitted, strict=True) if f])
    model.slope, model.offset = logistic_fit(margins, labels[fitted])
    return model


def training_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, usable: Column, per_class: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of the sample.  The keys are picked from the labels alone, so that documents need no shuffle: at
    most 2 * per_class keys are broadcast."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & usable).groupBy(key).agg(F.max(label).alias("_y"))
    picked = [known.filter(F.col("_y") == y).orderBy(F.xxhash64(key), key).limit(per_class) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    rows = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(picked), key).select("_text", "_y", key).collect()
    rows.sort(key=lambda r: (str(r[key]), r["_text"] or ""))
    return [r["_text"] or "" for r in rows], np.array([r["_y"] for r in rows], np.float64)


def score(df: DataFrame, key: str, text: str, model: ToxicityModel | None) -> DataFrame:
    """``(key, score double)`` of every row."""
    return _scored(df.select(F.col(key), F.col(text).alias("_text")), "_text", model, [key])


def with_score(df: DataFrame, text: str, model: ToxicityModel | None) -> DataFrame:
    """df's rows with a column ``score`` (in place of one that df has), in the pass that scores them: nothing is shuffled."""
    rows = df.drop("score")
    return _scored(rows, text, model, rows.columns)


def _scored(rows: DataFrame, text: str, model: ToxicityModel | None, passed: list[str]) -> DataFrame:
    if model is None:
        return rows.select(*passed, F.lit(0.0).alias("score"))
    shared, name = rows.sparkSession.sparkContext.broadcast(model), f"toxicity {uuid.uuid4().hex}"
    at, places = rows.columns.index(text), [rows.columns.index(c) for c in passed]
    kinds = ", ".join(f"`{c}` {rows.schema[i].dataType.simpleString()}" for i, c in zip(places, passed, strict=True))

    def run(batches):
        own = shared.value
        words = kept(name, lambda: WordNumbers(own))
        for batch in batches:
            for part, _ in by_bytes(batch, at, 1 << 20, 512):
                scores = [own.score(t, words) for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), pa.array(scores, pa.float64())], [*passed, "score"])

    return rows.mapInArrow(run, f"{kinds}, score double")
