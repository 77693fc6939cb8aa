"""Quality, toxicity and language against gradients, plain rules and held-out accuracy on small texts."""

import random
import zlib

import numpy as np
import pytest

from scribelake.llm import langid, quality, toxicity

RNG = random.Random(12)
WORDS = {
    "en": ["the", "and", "thing", "house", "water", "shelf", "weather", "knowing"],
    "de": ["der", "und", "schön", "straße", "wasser", "möglich", "pfad", "zeit"],
    "fr": ["le", "et", "élève", "rue", "beaucoup", "château", "oiseau", "être"],
}


def prose(lang="en", n=60):
    return " ".join(RNG.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


def bad_prose():
    text = prose()
    return RNG.choice([text.upper().replace(" ", "!! "), text.replace(" ", " | "), text.replace(" ", "%%% ")])


def documents(spark, folder, n=240):
    docs, labels = [], []
    for i in range(n):
        lang = RNG.choice(["en", "de", "fr"])
        good, toxic = RNG.random() < 0.7, RNG.random() < 0.4
        words = (prose(lang) if good else bad_prose()).split()
        if toxic:
            words.insert(RNG.randrange(len(words)), RNG.choice(["idiotic", "scumbag", "idiots", "scum", "idiot"]))
        docs.append((i, " ".join(words), lang if good else "en", "s", 9))
        labels.append((i, int(good), int(toxic)))
    docs += [(n, None, None, "s", 9), (n + 1, "", "en", "s", 9), (n + 2, "12 + 34!", "en", "s", 9), (None, prose("de"), None, "s", 9), (3, docs[3][1], "en", "s", 9), (n + 3, "id10ts " * 20000, "en", "s", 9)]
    labels += [(n, 1, 0), (None, 0, 1), (n + 1, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score int").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return docs, {k: (q, t) for k, q, t in labels}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf") / "t")
    return (folder, *documents(spark, folder))


def crc(i, m):
    return zlib.crc32(str(i).encode()) % m


def test_quality(spark, tables):
    folder, docs, labels = tables
    rows = quality.op2_bradley_terry_quality(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1
        assert r["held_out"] == (None if r["doc_id"] is None else crc(r["doc_id"], 4) == 2)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 240]
    assert np.mean([r["predicted"] == labels[r["doc_id"]][0] for r in held]) > 0.95


def test_toxicity(spark, tables):
    folder, docs, labels = tables
    rows = toxicity.op4_subword_bag_toxicity(spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1
        assert r["held_out"] == (None if r["doc_id"] is None else crc(r["doc_id"], 5) == 0)
    held = [r for r in rows if r["held_out"] and r["doc_id"] < 240]
    assert np.mean([r["predicted"] == labels[r["doc_id"]][1] for r in held]) > 0.9


def test_misspellings_share_grams():
    rows = [(prose() + (" idiot stupid" if k % 2 else ""), k % 2) for k in range(200)]
    scorer = toxicity.Scorer(toxicity.fit(rows, 0.5))
    plain, bent = scorer.scores([prose(), prose(n=20) + " idiott stupiid"])
    assert plain < 0.5 < bent


def test_grams_are_those_of_each_word():
    words = ["abc", "", "éa", "abcdefghij"]
    ids, sizes = toxicity.gram_ids(words)
    assert len(ids) == sizes.sum() and sizes.tolist() == [1 + 3 + 2 + 1, 1, 1 + 3 + 2 + 1, 1 + 10 + 9 + 8 + 7]
    for k, w in enumerate(words):
        alone, _ = toxicity.gram_ids([w])
        assert ids[sizes[:k].sum() :][: sizes[k]].tolist() == alone.tolist()


def test_best_window_is_the_highest_mean():
    x = np.random.default_rng(0).normal(size=101)
    best, begin, end = toxicity.best_window(x, 10)
    assert best == pytest.approx(max(x[b : b + 10].mean() for b in range(92))) and x[begin:end].mean() == pytest.approx(best)
    assert toxicity.best_window(x[:0]) == (0.0, 0, 0) and toxicity.best_window(x[:1], 10) == (pytest.approx(x[0]), 0, 1)


def test_joint_gradients():
    rng = np.random.default_rng(4)
    ids, sizes = np.array([0, 2, 2, 1, 3]), np.array([2, 1, 2])  # three words of five grams
    grams, bags = toxicity._Bags(ids, sizes, 5), toxicity._Bags(np.array([0, 1, 2, 2]), np.array([1, 3]), 3)
    params = {"table": rng.normal(size=(5, 3)), "layer": rng.normal(size=(3, 2)), "bias": rng.normal(size=2)}
    y, weight = np.array([1, 0]), np.array([0.7, 0.3])

    def plain_loss():
        words = [np.mean([params["table"][i] for i in part], axis=0) for part in ([0, 2], [2], [1, 3])]
        hidden = [words[0], (words[1] + 2 * words[2]) / 3]
        total = 0.0
        for h, label, w in zip(hidden, y, weight):
            logits = h @ params["layer"] + params["bias"]
            total -= w * (logits[label] - np.log(np.exp(logits).sum()))
        return total

    loss, grads = toxicity.joint_gradients(params, grams, bags, y, weight)
    assert loss == pytest.approx(plain_loss())
    for name, value in params.items():
        for at in np.ndindex(value.shape):
            held, step = value[at], 1e-6
            value[at] = held + step
            up = plain_loss()
            value[at] = held - step
            down = plain_loss()
            value[at] = held
            assert grads[name][at] == pytest.approx((up - down) / 2 / step, abs=1e-5), (name, at)


def test_scores_are_those_of_the_highest_window():
    rows = [(prose() + (" idiot" if k % 2 else ""), k % 2) for k in range(120)]
    model = toxicity.fit(rows, 0.5)

    def plain(text):
        values = []
        for word in (text or "").split():
            ids, _ = toxicity.gram_ids([toxicity.word_of(word)])
            values.append(float(np.mean([model["grams"][i] for i in ids])))
        n = toxicity.WINDOW
        best = max((sum(values[i : i + n]) / len(values[i : i + n]) for i in range(max(1, len(values) - n + 1))), default=0.0) if values else 0.0
        return 1 / (1 + np.exp(-(model["slope"] * best + model["offset"])))

    texts = [None, "", "one", prose(), prose() + " Idiot!", prose(n=4000) + " idiot " + prose(n=4000)]
    assert toxicity.Scorer(model).scores(texts) == pytest.approx([plain(t) for t in texts], abs=1e-5)
    assert [s >= 0.5 for s in toxicity.Scorer(model).scores(texts)[3:]] == [False, True, True]


def test_pairwise_fit_is_at_the_minimum():
    """Newton's weights against the gradient of the pairwise loss, by plain loops."""
    rng = random.Random(2)
    rows = [(prose(n=rng.randrange(5, 60)) if k % 2 else bad_prose(), k % 2) for k in range(60)]
    model = quality.fit(rows, 0.5)
    x = np.array([quality.features(t) for t, _ in rows])
    z = quality._expand(x, model)
    pick = np.random.default_rng(3)
    better, worse = pick.choice(np.flatnonzero([y == 1 for _, y in rows]), quality.PAIRS), pick.choice(np.flatnonzero([y == 0 for _, y in rows]), quality.PAIRS)
    gradient = quality.RIDGE * model["weights"]
    for a, b in zip(better, worse):
        d = z[a] - z[b]
        gradient = gradient - d / (1 + np.exp(d @ model["weights"])) / quality.PAIRS
    assert np.abs(gradient).max() < 1e-6


def test_one_kind_of_label():
    for module in (toxicity, quality):
        model = module.fit([("a b", 1)], 1.0)
        score = toxicity.Scorer(model).scores([None, "x"]) if module is toxicity else quality.score_texts([None, "x"], model)
        assert all(s > 0.99 for s in score)
        module.fit([], 0.0)


def test_language(spark, tables):
    folder, docs, _ = tables
    rows = {(r["doc_id"], k): r for k, r in enumerate(langid.op10_byte_recurrent_language(spark, folder).collect())}
    assert len(rows) == len(docs)
    by = {k[0]: r for k, r in rows.items()}
    for i in (240, 241, 242):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[None]["lang_pred"] == "de" and by[None]["held_out"] is None
    lang = {d[0]: d[2] for d in docs}
    held = [r for i, r in by.items() if i is not None and i < 240 and r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_backpropagation_through_time():
    rng = np.random.default_rng(1)
    params = {k: v.astype(np.float64) for k, v in langid.initial(3, rng, hidden=4).items()}
    codes, mask = langid.padded([b" ab ", b"xyz long", b"q"])
    y = np.array([0, 2, 1])
    _, grads = langid.loss_gradients(params, codes, mask, y)
    for name in params:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in params[name].shape)
            if name.startswith("in_"):
                at = (int(codes[1, rng.integers(0, 8)]), at[1])
            step = 1e-3
            held = params[name][at]
            params[name][at] = held + step
            up, _ = langid.loss_gradients(params, codes, mask, y)
            params[name][at] = held - step
            down, _ = langid.loss_gradients(params, codes, mask, y)
            params[name][at] = held
            assert grads[name][at] == pytest.approx((up - down) / 2 / step, abs=2e-4), name


def plain_network(model, raw):
    """Mean label probabilities over the positions of a text: one step at a time, in one pass either way."""

    def read(side, order):
        n = model[f"new_{side}"].shape[0]
        h, states = np.zeros(n), {}
        for t in order:
            x = model[f"in_{side}"][raw[t]].astype(float)
            open_ = [min(1.0, max(0.0, 0.25 * v + 0.5)) for v in x[: 2 * n] + h @ model[f"gates_{side}"]]
            z, r = np.array(open_[:n]), np.array(open_[n:])
            c = np.tanh(x[2 * n :] + (r * h) @ model[f"new_{side}"])
            h = (1 - z) * h + z * c
            states[t] = h
        return states

    forward, backward = read("f", range(len(raw))), read("b", range(len(raw) - 1, -1, -1))
    total = np.zeros(len(model["labels"]))
    for t in range(len(raw)):
        p = np.exp(np.concatenate((forward[t], backward[t])) @ model["out"] + model["out_bias"])
        total += p / p.sum()
    return total / len(raw)


def test_whole_texts_against_a_plain_network():
    model = langid.fit([(prose(k, 100), k) for k in WORDS for _ in range(5)], steps=150)
    labeller = langid.Labeller(model)
    texts = [prose(k, n) for k in WORDS for n in (1, 3, 30)] + ["x", "é", prose("de", 40) + prose("fr", 90), "straße" * 60]
    raw = [t.encode() for t in texts]
    got = labeller.probabilities(raw)
    for p, r in zip(got, raw):
        if len(r) <= langid.CHUNK:
            assert p == pytest.approx(plain_network(model, r), abs=1e-4)
    # In chunks, the state of CARRY bytes stands for that of all before.
    long = [prose("en", 400).encode(), (prose("de", 300) + prose("fr", 200)).encode()]
    for p, r in zip(labeller.probabilities(long), long):
        assert p == pytest.approx(plain_network(model, r), abs=0.01)
    # Whatever stands beside it, a text is labelled alike.
    assert np.allclose(labeller.probabilities(long + raw)[2:], got, atol=1e-5)
    small = labeller.label(texts + [None, "12", ""])
    assert small[-3:] == [("und", 0.0)] * 3 and [a for a, _ in small[:-3]] == [model["labels"][int(p.argmax())] for p in got]
    assert langid.Labeller(langid.fit([])).label(["hello"]) == [("und", 0.0)]


def test_quality_learns_from_all_labelled_rows(spark, monkeypatch):
    """Mean and spread are those of every row and of whole texts, each row is in a pair, and the model orders the rows."""
    rows = [(k % 2, f"{k} " + (prose(n=30) if k % 2 else "$$ !! || x9 " * 12)) for k in range(600)] + [(0, "a " * 40_000)]
    table = spark.createDataFrame(rows, "label int, text string").repartition(3)
    x = np.array([quality.features(t) for _, t in rows])
    featured, total = quality._numbered(quality._featured(table))
    assert total == [301, 300] and sorted((r["label"], r["n"]) for r in featured.select("label", "n").collect()) == [(y, n) for y in (0, 1) for n in range(total[y])]
    monkeypatch.setattr(quality, "PAIRS", 900)
    pairs = quality._pairs(featured, total).collect()
    assert len(pairs) == 2 * 601 and {tuple(r["better"]) for r in pairs} == {tuple(v) for v, (y, _) in zip(x, rows) if y}
    assert {tuple(r["worse"]) for r in pairs} == {tuple(v) for v, (y, _) in zip(x, rows) if not y}
    model = quality.fit_labelled(table, 0.5)
    assert np.allclose(model["mean"], x.mean(axis=0)) and np.allclose(model["scale"], x.std(axis=0) + 1e-6)
    scores = quality.score_texts([t for _, t in rows], model)
    assert np.mean((scores >= quality.KEEP_FROM) == [y == 1 for y, _ in rows]) > 0.99
