"""Toxicity (operator 4): a bag of subword embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams (with word ends marked), an instance the mean of its
words, and a softmax layer reads the instance; embeddings and layer are trained together by backpropagation. An unseen
misspelling shares n-grams with the word that it bends. Few words of a long text are toxic, so an instance is a window
of WINDOW words. Which window of a fitting row is its instance is not known: the rows are halved, each half has its own
embeddings, and the other half's, which have not seen the row, choose its highest window. The first epochs take whole
rows; then, ROUNDS times, windows are chosen anew (those of clean rows are kept from round to round). A text's score is
that of its highest window under the mean of the two halves' logits, which a logistic scale maps to 0..1; that scale is
fitted on the windows that the other half chose, with both labels weighing alike.

Fitted on at most MAX_ROWS_EACH rows of each label of the training remainders, of which FIT_CHARS characters at most are
read; every document is scored over its whole text, however long. Null and empty texts score as a text of no words.
Repeated rows score alike; ties of windows go to the first. Without labels of both kinds every score is the share of
label 1 (0 without labels). held_out is null for a null doc_id. An empty table gives an empty one. Other columns of
docs are ignored by the query; with_toxicity keeps them and replaces a column of the name of its result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import holdout_bucket, labelled_sample, read_table

MAX_ROWS_EACH, DIMENSION, BUCKETS, GRAMS = 1500, 4, 1 << 16, (3, 4, 5, 6)
WINDOW, FIRST_EPOCHS, EPOCHS, ROUNDS, RATE = 2, 12, 10, 5, 0.15
MEMO_ENTRIES = 300_000
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»…“”’"


PRIME = 0x9E3779B97F4A7C15


def word_of(piece: str) -> str:
    return piece.lower().strip(_EDGE)


def gram_ids(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams (of UTF-8 bytes) of all words and of each whole word, and how many each word has; a
    word's stand together."""
    raw = [b"<%b>" % w.encode("utf-8", "replace") for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    octets = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(raw)), sizes)
    begin = np.cumsum(sizes) - sizes
    left = (begin + sizes)[owner] - np.arange(len(octets))
    prime, mask = np.uint64(PRIME), (1 << 64) - 1
    whole = np.add.reduceat(octets * (prime ** ((np.arange(len(octets)) - begin[owner]) % 61 + 2).astype(np.uint64)), begin)
    owners, ids, run = [np.arange(len(raw))], [whole], octets
    for n in range(2, max(GRAMS) + 1):
        run = run[:-1] * prime + octets[n - 1 :]
        if n in GRAMS:
            fits = np.flatnonzero(left[: len(run)] >= n)
            owners.append(owner[fits])
            ids.append(run[fits] + np.uint64(n * PRIME & mask))
    owners, ids = np.concatenate(owners), np.concatenate(ids)
    order = np.argsort(owners, kind="stable")
    mixed = (ids ^ (ids >> np.uint64(29))) * prime
    return (mixed[order] >> np.uint64(64 - int(buckets).bit_length() + 1)).astype(np.int64), np.bincount(owners, minlength=len(raw))


class _Bags:
    """Means of rows over index lists, and their gradients, by sorted segment sums."""

    def __init__(self, index: np.ndarray, size: np.ndarray, rows: int):
        self.index, self.size = index, size
        self.begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        order = np.argsort(self.index, kind="stable")
        self.owner = owner[order]
        self.used, self.at = np.unique(self.index[order], return_index=True)
        self.rows = rows

    def mean(self, table: np.ndarray) -> np.ndarray:
        return np.add.reduceat(table[self.index], self.begin, axis=0) / self.size[:, None]

    def back(self, grad: np.ndarray) -> np.ndarray:
        out = np.zeros((self.rows, grad.shape[1]), grad.dtype)
        out[self.used] = np.add.reduceat((grad / self.size[:, None])[self.owner], self.at, axis=0)
        return out


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.state = rate, 0, {}

    def step(self, params: dict, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            m, v = self.state.get(k, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            self.state[k] = m, v
            params[k] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-9)


def _logistic(x, y, weight, steps: int = 200) -> tuple[float, float]:
    """Slope and offset by Newton's method; the slope is kept positive."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        e, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        hessian = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        da, db = np.linalg.solve(hessian, [(e * x).sum() + 1e-3 * (a - 1), e.sum()])
        a, b = max(a - 0.5 * da, 1e-3), b - 0.5 * db
    return a, b


class _Half:
    """Embeddings and softmax layer of one half of the fitting rows."""

    def __init__(self, rng: np.random.Generator, ids: np.ndarray, sizes: np.ndarray):
        self.ids, self.sizes, self.begin = ids, sizes, np.cumsum(sizes) - sizes
        self.params = {
            "table": rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32),
            "layer": rng.normal(0, 0.5, (DIMENSION, 2)).astype(np.float32), "bias": np.zeros(2, np.float32),
        }

    def train(self, instances: list[np.ndarray], y: np.ndarray, epochs: int) -> None:
        """instances: word numbers. Each label weighs alike."""
        used, words = np.unique(np.concatenate(instances), return_inverse=True)
        sizes = self.sizes[used]
        at = np.repeat(self.begin[used] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        grams = _Bags(self.ids[at], sizes, BUCKETS)
        bags = _Bags(words, np.array([len(x) for x in instances]), len(used))
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())).astype(np.float32)
        adam = _Adam(RATE)
        for _ in range(epochs):
            adam.step(self.params, joint_gradients(self.params, grams, bags, y, weight)[1])

    def flat(self) -> np.ndarray:
        """What each n-gram adds to the difference of the two logits."""
        return (self.params["table"] @ (self.params["layer"][:, 1] - self.params["layer"][:, 0])).astype(np.float32)

    def word_scores(self) -> np.ndarray:
        return np.add.reduceat(self.flat()[self.ids], self.begin) / self.sizes


def joint_gradients(params: dict, grams: _Bags, bags: _Bags, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Weighted cross entropy of the instances and its gradients by embeddings, layer and bias."""
    hidden = bags.mean(grams.mean(params["table"]))
    logits = hidden @ params["layer"] + params["bias"]
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    loss = -float((weight * np.log(np.maximum(p[np.arange(len(y)), y], 1e-12))).sum())
    d = (p - np.eye(2, dtype=np.float32)[y]) * weight[:, None]
    table = grams.back(bags.back(d @ params["layer"].T)) + 1e-6 * params["table"]
    return loss, {"table": table, "layer": hidden.T @ d, "bias": d.sum(axis=0)}


def fit(rows: list[tuple[str, int]], share: float = 0.5, seed: int = 7) -> dict:
    """The model as {"grams": one number a bucket, "slope", "offset"}; softmax over two classes is the sigmoid of the
    difference of their logits, so each bucket needs its share of that difference alone. share: of label 1 among all
    labels, the score of every text where rows of one label are all there is."""
    y = np.array([int(v) for _, v in rows])
    if len(rows) < 4 or min((y == 0).sum(), (y == 1).sum()) < 2:
        logit = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return {"grams": np.zeros(BUCKETS, np.float32), "slope": 1.0, "offset": logit}
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ([word_of(p) for p in t.split()] or [""])]) for t, _ in rows]
    rng = np.random.default_rng(seed)
    half = np.zeros(len(rows), int)
    for label in (0, 1):
        mine = rng.permutation(np.flatnonzero(y == label))
        half[mine[: len(mine) // 2]] = 1
    grams = gram_ids(list(vocabulary))
    halves = [_Half(rng, *grams) for _ in range(2)]
    for k, model in enumerate(halves):
        model.train([docs[i] for i in np.flatnonzero(half == k)], y[half == k], FIRST_EPOCHS)
    clean: list[list[np.ndarray]] = [[], []]
    for turn in range(ROUNDS + 1):
        scores = [model.word_scores() for model in halves]
        tops = [best_window(scores[1 - k][d]) for d, k in zip(docs, half)]
        if turn == ROUNDS:
            break
        for k, model in enumerate(halves):
            toxic = [docs[i][slice(*tops[i][1:])] for i in np.flatnonzero((half == k) & (y == 1))]
            clean[k] += [docs[i][slice(*tops[i][1:])] for i in np.flatnonzero((half == k) & (y == 0))]
            model.train(toxic + clean[k], np.array([1] * len(toxic) + [0] * len(clean[k])), EPOCHS)
    highest = np.array([t[0] for t in tops])
    spread = [highest[half == 1 - k].std() or 1.0 for k in (0, 1)]  # of what half k scored
    slope, offset = _logistic(highest / np.where(half == 0, spread[1], spread[0]), y, np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean()))
    return {"grams": sum(model.flat() / s / 2 for model, s in zip(halves, spread)).astype(np.float32), "slope": slope, "offset": offset}


def best_window(scores: np.ndarray, window: int = WINDOW) -> tuple[float, int, int]:
    """(mean, begin, end) of the window of `window` words with the highest mean; a shorter text is one window."""
    n = len(scores)
    if n <= window:
        return (float(scores.mean()) if n else 0.0), 0, n
    sums = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    means = (sums[window:] - sums[:-window]) / window
    k = int(means.argmax())
    return float(means[k]), k, k + window


class Scorer:
    """Scores whole texts; keeps the words it has seen in a bounded memo."""

    def __init__(self, model: dict, memo_entries: int = MEMO_ENTRIES):
        self.model, self.limit, self.memo = model, memo_entries, {}

    def _learn(self, pieces: list[str]) -> None:
        ids, sizes = gram_ids([word_of(p) for p in pieces])
        values = np.add.reduceat(self.model["grams"][ids], np.cumsum(sizes) - sizes) / sizes
        self.memo.update(zip(pieces, values.tolist()))

    def scores(self, texts, at_once: int = 64) -> list[float]:
        out, texts = [], list(texts)
        for k in range(0, len(texts), at_once):
            if len(self.memo) > self.limit:
                self.memo.clear()
            split = [t.split() if isinstance(t, str) else [] for t in texts[k : k + at_once]]
            new = list(set().union(*split).difference(self.memo))
            if new:
                self._learn(new)
            for pieces in split:
                values = np.fromiter(map(self.memo.__getitem__, pieces), np.float64, len(pieces))
                x = self.model["slope"] * best_window(values)[0] + self.model["offset"]
                out.append(float(1 / (1 + np.exp(-np.clip(x, -30, 30)))))
        return out


def with_toxicity(docs: DataFrame, model: dict, out: str = "score") -> DataFrame:
    """Add column out: the toxicity of column text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the number of documents
    workers: dict[str, Scorer] = {}

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not workers:
            workers["scorer"] = Scorer(shared.value)
        return pd.Series(workers["scorer"].scores(texts), dtype="float64")

    return docs.withColumn(out, score("text"))


def op4_subword_bag_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(*labelled_sample(docs, read_table(spark, sf_dir, "labels"), "toxic", 5, 0, MAX_ROWS_EACH))
    scored = with_toxicity(docs, model)
    return scored.select("doc_id", (holdout_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op4_subword_bag_toxicity": op4_subword_bag_toxicity}
ORACLE_SQL: dict[str, str] = {}
