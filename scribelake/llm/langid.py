"""Language identification (operator 10): a bidirectional gated recurrent network over bytes, in numpy.

The network reads the UTF-8 bytes of a whole text forward and backward and labels every position; a text's
probabilities are the mean of those of all its positions. It is trained by backpropagation through time on runs of SPAN
bytes that begin anywhere in labelled texts. A long text is read in chunks of CHUNK bytes at once, and each begins with
the state that the CARRY bytes before it (behind it, backward) leave: by then the gates have let go of what came
earlier (a test compares this with one pass over the whole text), so that one very long text takes as long as many short
ones of as many bytes.

Learned from at most MAX_ROWS_EACH labelled texts a language, of which FIT_CHARS characters at most are read; every document is
labelled over its whole text. A null text and one without a letter is `und`, with score 0. Without any labelled text
every document is `und`. Repeated rows are labelled alike; ties go to the label that sorts first. held_out is null for a null doc_id. An
empty table gives an empty one. Other columns of docs are ignored by the query; with_language keeps them and replaces
columns of the names of its results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FIT_CHARS, holdout_bucket, read_table, unused

MAX_ROWS_EACH, HIDDEN = 300, 8
SPAN, STEPS, BATCH, RATE = 64, 500, 64, 0.02
CHUNK, CARRY, COLUMNS, AT_ONCE = 256, 32, 1024, 1 << 22  # chunks side by side; bytes of texts in hand
UNKNOWN = "und"


def gate(x: np.ndarray) -> np.ndarray:
    """A gate's opening, 0 to 1: the straight-line sigmoid."""
    return np.clip(0.25 * x + 0.5, 0, 1)


def _slope(opening: np.ndarray) -> np.ndarray:
    return 0.25 * ((opening > 0) & (opening < 1))


def padded(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    width = int(sizes.max())
    codes = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in runs), np.uint8).reshape(len(runs), width)
    return codes, np.arange(width) < sizes[:, None]


def initial(n_labels: int, rng: np.random.Generator, hidden: int = HIDDEN) -> dict:
    draw = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    params = {"out": draw(2 * hidden, n_labels), "out_bias": np.zeros(n_labels, np.float32)}
    for side in "fb":
        params |= {f"in_{side}": draw(256, 3 * hidden), f"gates_{side}": draw(hidden, 2 * hidden), f"new_{side}": draw(hidden, hidden)}
    return params


def _run(params: dict, side: str, codes: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states at every position, read forward (f) or backward (b)."""
    n, width = codes.shape
    hidden = params[f"new_{side}"].shape[0]
    table, gates, new = params[f"in_{side}"], params[f"gates_{side}"], params[f"new_{side}"]
    states, tape, h = np.empty((width, n, hidden), np.float32), [], np.zeros((n, hidden), np.float32)
    for t in range(width) if side == "f" else range(width - 1, -1, -1):
        x = table[codes[:, t]]
        zr = gate(x[:, : 2 * hidden] + h @ gates)
        z, r = zr[:, :hidden], zr[:, hidden:]
        c = np.tanh(x[:, 2 * hidden :] + (r * h) @ new)
        m = mask[:, t, None]
        after = np.where(m, h + z * (c - h), h)
        if keep:
            tape.append((t, h, z, r, c, m))
        h = states[t] = after
    return states, tape


def positions(params: dict, codes: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Label probabilities at every position: (width, n, labels)."""
    forward, tape_f = _run(params, "f", codes, mask, keep)
    backward, tape_b = _run(params, "b", codes, mask, keep)
    both = np.concatenate((forward, backward), axis=2)
    logits = both @ params["out"] + params["out_bias"]
    logits -= logits.max(axis=2, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=2, keepdims=True)
    return p, (both, tape_f, tape_b)


def loss_gradients(params: dict, codes: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean cross entropy over positions, and its gradients by backpropagation through time."""
    p, (both, tape_f, tape_b) = positions(params, codes, mask, keep=True)
    live, total = mask.T[:, :, None], mask.sum()
    loss = -float(np.log(np.maximum(np.take_along_axis(p, y[None, :, None], 2), 1e-9))[live].sum() / total)
    d = p.copy()
    d[:, np.arange(len(y)), y] -= 1
    d = d * live / total
    hidden = params["new_f"].shape[0]
    grads = {"out": np.tensordot(both, d, ((0, 1), (0, 1))), "out_bias": d.sum(axis=(0, 1))}
    d_both = d @ params["out"].T
    for side, tape, d_states in (("f", tape_f, d_both[:, :, :hidden]), ("b", tape_b, d_both[:, :, hidden:])):
        gates, new = params[f"gates_{side}"], params[f"new_{side}"]
        g_in, g_gates, g_new = np.zeros_like(params[f"in_{side}"]), np.zeros_like(gates), np.zeros_like(new)
        d_h = np.zeros((len(y), hidden), np.float32)
        for t, h, z, r, c, m in reversed(tape):
            d_h = d_h + d_states[t]
            d_step = d_h * m
            d_c = d_step * z * (1 - c * c)
            d_rh = d_c @ new.T
            d_zr = np.concatenate((d_step * (c - h) * _slope(z), d_rh * h * _slope(r)), axis=1)
            np.add.at(g_in, codes[:, t], np.concatenate((d_zr, d_c), axis=1))
            g_gates += h.T @ d_zr
            g_new += (r * h).T @ d_c
            d_h = d_h * ~m + d_step * (1 - z) + d_rh * r + d_zr @ gates.T
        grads |= {f"in_{side}": g_in, f"gates_{side}": g_gates, f"new_{side}": g_new}
    return loss, grads


def fit(rows: list[tuple[str, str]], seed: int = 11, steps: int = STEPS) -> dict:
    """{"labels": sorted labels, and the network's arrays}; each label weighs alike."""
    labels = sorted({y for _, y in rows})
    rng = np.random.default_rng(seed)
    pools = [[t.encode("utf-8", "replace") for t, y in rows if y == label and t] for label in labels]
    pools = [p or [b" "] for p in pools]
    chances = [np.array([len(t) for t in p]) / sum(map(len, p)) for p in pools]
    model = {"labels": labels}
    if not labels:
        return model

    def span(k: int) -> bytes:
        text = pools[k][rng.choice(len(pools[k]), p=chances[k])]
        begin = int(rng.integers(0, max(1, len(text) - SPAN // 2)))
        return text[begin : begin + SPAN]

    params, state = initial(len(labels), rng), {}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(labels), BATCH)
        codes, mask = padded([span(k) for k in y])
        _, grads = loss_gradients(params, codes, mask, y)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = g / max(1.0, norm)
            m, v = state.get(k, (0.0, 0.0))
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[k] = m, v
            params[k] = (params[k] - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model | params


class _Side:
    """One direction of the network over many chunks side by side: states are (hidden, chunks)."""

    def __init__(self, model: dict, side: str):
        flip = lambda x: np.ascontiguousarray(x.T.astype(np.float32))
        self.table, self.gates, self.new = flip(model[f"in_{side}"]), flip(model[f"gates_{side}"]), flip(model[f"new_{side}"])
        self.hidden = n = len(self.new)
        self.table[: 2 * n] = self.table[: 2 * n] / 4 + 0.5  # as in gate
        self.gates /= 4

    def step(self, h: np.ndarray, codes: np.ndarray) -> np.ndarray:
        n = self.hidden
        x = np.take(self.table, codes, axis=1, mode="clip")
        g = self.gates @ h
        g += x[: 2 * n]
        np.maximum(g, 0, out=g)
        np.minimum(g, 1, out=g)
        c = self.new @ (g[n:] * h)
        c += x[2 * n :]
        np.tanh(c, out=c)
        c -= h
        c *= g[:n]
        c += h
        return c


class Labeller:
    """(label, score) of whole texts."""

    def __init__(self, model: dict):
        self.labels = model["labels"]
        if self.labels:
            self.forward, self.backward = _Side(model, "f"), _Side(model, "b")
            self.out, self.bias = np.ascontiguousarray(model["out"].T.astype(np.float32)), model["out_bias"].astype(np.float32)[:, None]

    def _block(self, raw: np.ndarray, first: np.ndarray, begin: np.ndarray, size: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Sums of label probabilities over the positions of each chunk raw[begin : begin + size], longest chunk first;
        first, last: whether it begins and ends its text."""
        width, n = int(size[0]), len(size)
        index = begin + np.arange(width)[:, None]
        codes = raw[np.minimum(index, len(raw) - 1)].astype(np.intp)
        live = np.searchsorted(-size, -np.arange(width), "left")  # chunks longer than t
        state = np.zeros((self.forward.hidden, n), np.float32)
        inner = (~first).astype(np.float32)
        for t in range(CARRY):
            state = self.forward.step(state, raw[np.maximum(begin - CARRY + t, 0)]) * inner
        states = np.empty((width, 2 * self.forward.hidden, n), np.float32)
        half = self.forward.hidden
        for t in range(width):
            k = live[t]
            state = self.forward.step(state[:, :k], codes[t, :k])
            states[t, :half, :k] = state
        state, inner, end = np.zeros((half, n), np.float32), (~last).astype(np.float32), begin + size
        for t in range(CARRY - 1, -1, -1):
            state = self.backward.step(state, raw[np.minimum(end + t, len(raw) - 1)]) * inner
        for t in range(width - 1, -1, -1):
            k = live[t]
            states[t, half:, :k] = state[:, :k] = self.backward.step(state[:, :k], codes[t, :k])
        sums = np.zeros((len(self.labels), n), np.float32)
        for t in range(width):
            k = live[t]
            p = self.out @ states[t, :, :k]
            p += self.bias
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            sums[:, :k] += p
        return sums

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over the positions of each text; texts are not empty."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        raw = np.frombuffer(b"".join(texts), np.uint8)
        chunks = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(texts)), chunks)
        place = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        # Chunks of a text are of one size, give or take a byte, so that none is too short to carry a state on.
        base, more = sizes[owner] // chunks[owner], sizes[owner] % chunks[owner]
        begin = (np.cumsum(sizes) - sizes)[owner] + place * base + np.minimum(place, more)
        size = base + (place < more)
        order = np.argsort(-size, kind="stable")
        total = np.zeros((len(texts), len(self.labels)))
        for i in range(0, len(order), COLUMNS):
            at = order[i : i + COLUMNS]
            sums = self._block(raw, place[at] == 0, begin[at], size[at], place[at] == chunks[owner[at]] - 1)
            np.add.at(total, owner[at], sums.T)
        return total / sizes[:, None]

    def label(self, texts) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        held: list[tuple[int, bytes]] = []
        weight = 0

        def flush() -> None:
            if held:
                for (i, _), p in zip(held, self.probabilities([b for _, b in held])):
                    best = int(p.argmax())
                    out[i] = self.labels[best], float(min(1.0, p[best]))
                held.clear()

        for text in texts:
            out.append((UNKNOWN, 0.0))
            if self.labels and isinstance(text, str) and any(map(str.isalpha, text)):
                held.append((len(out) - 1, text.encode("utf-8", "replace")))
                weight += len(held[-1][1])
                if weight > AT_ONCE:
                    flush()
                    weight = 0
        flush()
        return out


def labelled_texts(docs: DataFrame, modulus: int, held: int, each: int = MAX_ROWS_EACH) -> list[tuple[str, str]]:
    """At most `each` (text, lang) of each language outside the held-out remainder, chosen by a hash of the id."""
    known = docs.where((holdout_bucket(F.col("doc_id"), modulus) != held) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("pick"))
    first = Window.partitionBy("lang").orderBy("pick", "doc_id")
    chosen = known.withColumn("n", F.row_number().over(first)).where(F.col("n") <= each).select("doc_id", "lang", "pick").distinct()
    # Bounded by each times the number of languages.
    rows = docs.select("doc_id", "text", "lang").join(F.broadcast(chosen), ["doc_id", "lang"]).where(F.col("text").isNotNull())
    found = rows.select("pick", "doc_id", "lang", F.left("text", F.lit(FIT_CHARS)).alias("text")).collect()
    found.sort(key=lambda r: (r["pick"], r["doc_id"], r["lang"], r["text"]))
    return [(r["text"], r["lang"]) for r in found]


def with_language(docs: DataFrame, model: dict) -> DataFrame:
    """Add columns lang_pred and score for column text."""
    workers: dict[str, Labeller] = {}

    @F.pandas_udf("lang_pred string, score double")
    def label(texts: pd.Series) -> pd.DataFrame:
        if not workers:
            workers["labeller"] = Labeller(model)
        return pd.DataFrame(workers["labeller"].label(texts), columns=["lang_pred", "score"])

    found, kept = unused(docs.columns, "found")[0], [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    return docs.withColumn(found, label("text")).select(*kept, f"{found}.lang_pred", f"{found}.score")


def op10_byte_recurrent_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(labelled_texts(docs, 4, 2))
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", (holdout_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_byte_recurrent_language": op10_byte_recurrent_language}
ORACLE_SQL: dict[str, str] = {}
