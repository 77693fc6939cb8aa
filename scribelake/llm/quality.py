"""Quality (operator 2): Bradley-Terry pairwise ranking.

A document's score is a weighted sum of surface features of its whole text. Weights come from preference pairs (a row
labelled 1 is preferred to a row labelled 0) by logistic loss on the difference of their features, so that
sigmoid(score a - score b) is the chance that a is preferred. The cut lies midway between the CUT_QUANTILE quantile
of the scores of label 0 and the 1 - CUT_QUANTILE quantile of those of label 1; scores are shifted so that the cut lies
at KEEP_FROM of 0..1.

Fitted on all labelled rows of the training remainders, over their whole texts: Spark finds the features, deals the pairs,
and sums gradients and Hessians; the driver holds the sums alone. Each row is paired with PARTNERS rows or more of the other
label. The quantiles are those of all rows' scores, to one rank in RANKS. Every document is scored over its whole text, however long. Null and empty texts have the features of a text of no words. Repeated rows score alike, and a score
at the cut is kept. Without labels of both kinds every score is the share of label 1 (1 without labels). held_out is null
for a null doc_id. An empty table gives an empty one. Other columns of docs are ignored by the query; with_quality keeps
them and replaces a column of the name of its result.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import holdout_bucket, materialize, maybe_marked, read_table

PAIRS, KEEP_FROM, CUT_QUANTILE, RIDGE = 40_000, 0.7, 0.998, 1e-3
PARTNERS, RANKS, STEPS = 2, 100_000, 30
FEATURES = (
    "log words", "word length", "spread of word length", "distinct words", "distinct lines", "upper case", "digits", "stops", "commas",
    "marks !", "marks |", "other marks", "white space", "other letters", "words in marks", "distinct word pairs", "most common word", "words a line",
)
_CLASS = np.zeros(256, np.uint8)
for _chars, _k in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), ("abcdefghijklmnopqrstuvwxyz", 2), ("0123456789", 3), (".?:;", 4), (",", 5), ("!", 6), ("|", 7), (" \t\n\r\x0b\x0c", 9)):
    for _c in _chars:
        _CLASS[ord(_c)] = _k
_CLASS[128:] = 10
for _c in range(33, 127):
    if not _CLASS[_c]:
        _CLASS[_c] = 8
_MARKED = re.compile(r"[^\w\s.,;:?'’\-]")


def features(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    kinds = np.bincount(_CLASS[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=11) / chars
    letters = max(kinds[1] + kinds[2] + kinds[10] / 2, 1e-9)
    lengths = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    lines = [x for x in text.split("\n") if x.strip()] or [""]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1)
    upper = (kinds[1] + sum(map(text.count, "ÀÂÄÇÈÉÊËÍÑÓÖÚÜ")) / chars) / letters
    marked = len(_MARKED.findall(text)) / max(1, n)
    return [
        np.log1p(n), np.log1p(lengths.mean()), np.log1p(lengths.std()), len(counts) / max(1, n), len(set(lines)) / len(lines), min(upper, 1.0),
        kinds[3], kinds[4], kinds[5], kinds[6], kinds[7], kinds[8], kinds[9], min(kinds[10], 1.0), min(marked, 3.0), pairs,
        max(counts.values(), default=0) / max(1, n), np.log1p(n / len(lines)),
    ]


def _expand(x: np.ndarray, model: dict) -> np.ndarray:
    """Standardized features and their squares."""
    z = np.clip((x - model["mean"]) / model["scale"], -8, 8)
    return np.concatenate((z, z * z / 4), axis=-1)


def _constant(n: int, share: float) -> dict:
    """The model without labels of both kinds: the share of label 1, whatever the text."""
    logit = np.log(max(share, 1e-6) / max(1 - share, 1e-6)) if n else 13.8
    return {"mean": np.zeros(len(FEATURES)), "scale": np.ones(len(FEATURES)), "weights": np.zeros(2 * len(FEATURES)), "slope": 1.0, "offset": float(logit)}


def _sums(d: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the pairwise logistic loss at w, summed over differences d."""
    p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
    return -(d * p[:, None]).sum(axis=0), (d * (p * (1 - p))[:, None]).T @ d


def _step(gradient: np.ndarray, hessian: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
    return np.linalg.solve(hessian / n + RIDGE * np.eye(len(w)), gradient / n + RIDGE * w)


def fit(rows: list[tuple[str, int]], share: float = 0.5, seed: int = 3) -> dict:
    """A model of few rows that are at hand; fit_labelled is for tables."""
    y = np.array([int(v) for _, v in rows])
    x = np.array([features(t) for t, _ in rows]).reshape(len(rows), len(FEATURES))
    flat = _constant(len(y), share)
    if len(set(y.tolist())) < 2:
        return flat
    model = flat | {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 1e-6}
    z = _expand(x, model)
    rng = np.random.default_rng(seed)
    better, worse = rng.choice(np.flatnonzero(y == 1), PAIRS), rng.choice(np.flatnonzero(y == 0), PAIRS)
    d = z[better] - z[worse]
    w = np.zeros(z.shape[1])
    for _ in range(STEPS):  # Newton's method on the pairwise logistic loss
        step = _step(*_sums(d, w), len(d), w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    scores = z @ w
    # Few rows of label 0 above the cut, and fewer rows of label 1 below it.
    return model | {"weights": w, "offset": _offset(np.quantile(scores[y == 0], CUT_QUANTILE), np.quantile(scores[y == 1], 1 - CUT_QUANTILE))}


def _offset(bad: float, good: float) -> float:
    return float(np.log(KEEP_FROM / (1 - KEEP_FROM)) - (bad + good) / 2)


def _features(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """rows (column key, of type kind, and text) -> key, x: the features of the text."""

    def of(batches):
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "x": [features(t) for t in batch["text"]]})

    return rows.select(key, "text").mapInPandas(of, f"{key} {kind}, x array<double>")


def _placed(rows: DataFrame) -> DataFrame:
    """rows (label, x) -> label, part, place, x: a row's place among those of its label in its part."""

    def of(batches):
        part, seen = TaskContext.get().partitionId(), [0, 0]
        for batch in batches:
            label = batch["label"].to_numpy()
            place = np.zeros(len(label), np.int64)
            for y in (0, 1):
                place[label == y] = seen[y] + np.arange((label == y).sum())
                seen[y] += int((label == y).sum())
            yield pd.DataFrame({"label": label, "part": part, "place": place, "x": batch["x"]})

    return materialize(rows.select("label", "x").mapInPandas(of, "label int, part int, place long, x array<double>"), "quality-features")


def _featured(rows: DataFrame) -> DataFrame:
    """rows (label, text) -> what _placed gives."""
    return _placed(_features(rows, "label", "int"))


def _numbered(rows: DataFrame) -> tuple[DataFrame, list[int]]:
    """rows of _placed and n, from 0 within a label; and the number of rows of each label."""
    sizes = rows.groupBy("label", "part").agg((F.max("place") + 1).alias("size")).collect()
    first, total = [], [0, 0]
    for r in sorted(sizes, key=lambda r: (r["label"], r["part"])):
        first.append((r["label"], r["part"], total[r["label"]]))
        total[r["label"]] += r["size"]
    starts = rows.sparkSession.createDataFrame(first, "label int, part int, first long")
    return rows.join(starts, ["label", "part"]).select("label", (F.col("first") + F.col("place")).alias("n"), "x"), total


def _pairs(rows: DataFrame, total: list[int]) -> DataFrame:
    """better, worse: the features of pairs of which each row is in as many as it takes for PAIRS in all, PARTNERS at least."""
    each = max(PARTNERS, -(-PAIRS // sum(total)))
    sides = []
    for y in (1, 0):
        other = rows.where(F.col("label") == 1 - y).select(F.col("n").alias("met"), F.col("x").alias("other"))
        own = rows.where(F.col("label") == y).select("n", "x", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("turn"))
        own = own.select("x", F.pmod(F.xxhash64(F.lit(y), "n", "turn"), F.lit(total[1 - y])).alias("met")).join(other, "met")
        sides.append(own.select(F.col("x" if y else "other").alias("better"), F.col("other" if y else "x").alias("worse")))
    return materialize(sides[0].unionByName(sides[1]), "quality-pairs")


def fit_labelled(rows: DataFrame, share: float) -> dict:
    """The model of all rows (label 0 or 1, text)."""
    return fit_featured(_features(rows, "label", "int"), share)


def fit_featured(rows: DataFrame, share: float) -> dict:
    """The model of all rows (label 0 or 1, x: features)."""
    featured = _placed(rows)
    each = [f(F.col("x")[i]) for f in (F.avg, F.stddev_pop) for i in range(len(FEATURES))]
    found = featured.agg(F.count("*"), F.min("label"), F.max("label"), *each).first()
    flat = _constant(found[0], share)
    if not found[0] or found[1] == found[2]:
        return flat
    model = flat | {"mean": np.array(found[3 : 3 + len(FEATURES)]), "scale": np.array(found[3 + len(FEATURES) :]) + 1e-6}
    pairs = _pairs(*_numbered(featured))
    count, w = pairs.count(), np.zeros(2 * len(FEATURES))
    matrix = lambda column: np.stack(column.to_numpy()).astype(np.float64)
    for _ in range(STEPS):

        def summed(batches, w=w):
            gradient, hessian = np.zeros(len(w)), np.zeros((len(w), len(w)))
            for batch in batches:
                if len(batch):
                    g, h = _sums(_expand(matrix(batch["better"]), model) - _expand(matrix(batch["worse"]), model), w)
                    gradient, hessian = gradient + g, hessian + h
            yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "sums": [np.concatenate((gradient, hessian.ravel()))]})

        parts = sorted(pairs.mapInPandas(summed, "part int, sums array<double>").collect())
        sums = np.sum([r["sums"] for r in parts], axis=0)
        step = _step(sums[: len(w)], sums[len(w) :].reshape(len(w), len(w)), count, w)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break

    def scored(batches):
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"label": batch["label"], "score": _expand(matrix(batch["x"]), model) @ w})

    scores = featured.select("label", "x").mapInPandas(scored, "label int, score double")
    cuts = scores.groupBy("label").agg(F.percentile_approx("score", [1 - CUT_QUANTILE, CUT_QUANTILE], RANKS).alias("q")).collect()
    low, high = ({r["label"]: r["q"][i] for r in cuts} for i in (0, 1))
    return model | {"weights": w, "offset": _offset(high[0], low[1])}


def score_texts(texts, model: dict) -> np.ndarray:
    x = np.array([features(t if isinstance(t, str) else None) for t in texts]).reshape(-1, len(FEATURES))
    return 1 / (1 + np.exp(-np.clip(_expand(x, model) @ model["weights"] + model["offset"], -30, 30)))


def with_quality(docs: DataFrame, model: dict, out: str = "score") -> DataFrame:
    """Add column out: the quality of column text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(score_texts(texts, model), dtype="float64")

    return docs.withColumn(out, score("text"))


def quality_model(spark: SparkSession, sf_dir: str) -> dict:
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text").where("text is not null and doc_id is not null")
    known = read_table(spark, sf_dir, "labels").where((holdout_bucket(F.col("doc_id"), 4) != 2) & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("label"))
    share = known.agg(F.avg("label")).first()[0]
    # Texts stay where they are read: the bitmap leaves out those without a label, and features alone meet the labels.
    marked = docs.where(maybe_marked(F.col("doc_id"), known.where("doc_id is not null").select(F.col("doc_id").cast("long"))))
    return fit_featured(_features(marked, "doc_id", "long").join(known.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id"), share or 0.0)


def op2_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = with_quality(read_table(spark, sf_dir, "documents").select("doc_id", "text"), quality_model(spark, sf_dir))
    return scored.select("doc_id", (holdout_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= KEEP_FROM).cast("int"))


QUERIES = {"op2_bradley_terry_quality": op2_bradley_terry_quality}
ORACLE_SQL: dict[str, str] = {}
