"""The pipeline against its stages in plain Python on a small table."""

import random
import zlib

import corpus_pipeline
from scribelake.llm import pii, quality
from scribelake.llm.tokens import PieceEncoder, vocabulary_path

from .test_decontamination import plain as plain_leaks
from .packing_tools import sequence_count
from .test_simhash import plain_components, plain_fingerprint


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    words = ["the", "and", "thing", "house", "water", "shelf", "weather", "knowing", "paper", "sound"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    items = [(i, say(30)) for i in range(5)]
    docs, labels = [], []
    for i in range(150):
        good = i % 4 != 0
        text = say(rng.randrange(40, 120)) + (f" Mail a.{i}@b.org now." if i % 7 == 0 else "")
        if i % 10 == 1:
            text += " " + items[i % 5][1]
        docs.append((i, text if good else text.upper().replace(" ", "!! "), "en", "s", len(text)))
        labels.append((i, int(good), 0))
    docs += [(150 + k, docs[5 + k][1], "en", "s", 1) for k in range(10)] + [(7, docs[7][1], "en", "s", 1), (300, None, None, None, None), (None, say(60), "en", "s", 1)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")

    model = quality.quality_model(spark, folder)
    kept = [d for d, s in zip(docs, quality.score_texts([d[1] for d in docs], model)) if s >= quality.KEEP_FROM]
    prints = [plain_fingerprint(d[1]) for d in kept]
    root = plain_components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for d, f in zip(kept, prints):
        first.setdefault(root[f], []).append((d[0] is None, d[0] or 0, d))
    kept = [min(group, key=lambda g: g[:2])[2] for group in first.values()]
    leaks = {d for d, _ in plain_leaks([d[:2] for d in kept], items)}
    kept = [(d[0], pii.redacted(d[1])) for d in kept if d[0] not in leaks]
    encode = PieceEncoder(vocabulary_path()).library.encode
    want = []
    for doc_id, text in kept:
        ids = encode(text or "", add_special_tokens=False).ids + [0]
        want.append((str(doc_id), 0, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))))

    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r["doc_id"]), r["piece"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    assert sequence_count(got, 2048) <= 1.25 * sum(r["length"] for r in got) / 2048 + 1
    assert 60 < len(want) < 112

    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame.withColumn("__extra", frame["doc_id"]), folder).columns == [*frame.columns, "__extra"]
        assert stage(spark, frame.where("false"), folder).count() == 0


def test_stages_hold_few_texts(spark, tmp_path):
    """Every stage bounds what a worker holds of whole texts, and leaves a smaller bound as it is."""
    key, folder = "spark.sql.execution.arrow.maxRecordsPerBatch", str(tmp_path / "sf")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs, given = spark.read.parquet(f"{folder}/documents.parquet"), spark.conf.get(key)
    try:
        for _, stage in corpus_pipeline.STAGES[:-1]:
            for before, after in (("10000", "1000"), ("0", "1000"), ("50", "50")):
                spark.conf.set(key, before)
                stage(spark, docs, folder)
                assert spark.conf.get(key) == after
    finally:
        spark.conf.set(key, given)
