"""What Python workers keep from one stage to the next."""

import gc

import pandas as pd

from scribelake.llm import common, decontamination, packing
from scribelake.llm.tokens import PieceEncoder, encoder, vocabulary_path


class Shared:
    """A broadcast variable of one block of items."""

    value = ([(1, "one two three four five six seven", 1)], {})


def held(kind: type) -> int:
    gc.collect()
    return sum(type(x) is kind for x in gc.get_objects())


def test_a_stage_does_not_keep_what_the_one_before_kept(spark):
    common._kept.clear()
    find = decontamination._finder(Shared).func
    for _ in range(2):
        assert [m["item_id"] for m in find(pd.Series(["zero one two three four five six seven", None]))[0]] == [1]
        assert held(decontamination._Hashes) == 1
    encode = encoder(vocabulary_path())
    assert encoder(vocabulary_path()) is encode and held(decontamination._Hashes) == 0
    del encode
    find(pd.Series(["other words"]))
    assert held(decontamination._Hashes) == 1 and held(PieceEncoder) == 0


def test_full_memos_give_the_same_ids():
    texts = [f"Words{i}, and more-{i % 7} words {i * i}." for i in range(50)]
    small = PieceEncoder(vocabulary_path(), memo_entries=20)
    assert [x for t in texts for x in small.encode([t])] == PieceEncoder(vocabulary_path()).encode(texts)
    assert len(small.memo) < 40


def test_packing_leaves_nothing_in_waiting_workers(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string").coalesce(1)
    assert packing.token_pieces(docs, vocabulary_path(), 0, 2048).count() == 2
    kept = docs.select("doc_id").mapInPandas(lambda batches: (pd.DataFrame({"n": [len(common._kept)]}) for _ in batches), "n long")
    assert {r["n"] for r in kept.collect()} == {0}
