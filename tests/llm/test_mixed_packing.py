import random
from functools import partial

import corpus_pipeline
from fathom.llm import mixing, packing
from fathom.llm.registry import word_tokenizer

from .odd import documents, prose, rows


def corpus(spark):
    rng = random.Random(6)
    return spark.createDataFrame([(i, prose(rng, 60), "ab"[i % 2]) for i in range(400)], "doc_id long, text string, source string")


def share_of_a(pieces):
    """The share of source a in the first quarter of the tokens, by sequence id."""
    pieces = sorted((p["sequence_id"], p["offset"], p["doc_id"], p["length"]) for p in pieces)
    total, at, a = sum(p[3] for p in pieces), 0, 0
    for _, _, doc, n in pieces:
        if at >= total / 4:
            break
        at += n
        a += n * (doc % 2 == 0)
    return a / at


def test_weights_reach_the_sequences(spark):
    docs = corpus(spark)
    shares = []
    for weights in ({"a": 9.0, "b": 1.0}, {"a": 1.0, "b": 9.0}):
        mixed = mixing.mixed(docs, weights, block_chars=1000, slots=10, place=mixing.PLACE)
        pieces = packing.pack(mixed, word_tokenizer(), shard_tokens=5000, with_ids=False, order=mixing.PLACE).collect()
        assert sum(p["length"] for p in pieces) == sum({p["doc_id"]: p["doc_tokens"] for p in pieces}.values())
        assert len({p["doc_id"] for p in pieces}) == 400
        shares.append(share_of_a(pieces))
    assert shares[0] > 0.75 and shares[1] < 0.25


def test_the_pipelines_rows_depend_on_the_weights(spark, monkeypatch):
    mixed, docs, got = mixing.mixed, corpus(spark), []
    for weights in ({"a": 9.0, "b": 1.0}, {"a": 1.0, "b": 9.0}):
        monkeypatch.setattr(mixing, "mixed", partial(mixed, weights=weights, block_chars=1000, slots=10))
        out = corpus_pipeline.sequence_packing(spark, corpus_pipeline.source_mixing(spark, docs, ""), "")
        got.append(sorted((r["sequence_id"], r["offset"], r["doc_id"], r["length"]) for r in out.collect()))
    assert sum(x[3] for x in got[0]) == sum(x[3] for x in got[1])
    assert got[0] != got[1]


def test_odd_tables(spark):
    mixed = mixing.mixed(documents(spark), block_chars=500, place=mixing.PLACE)
    assert mixed.count() == len(rows()) and mixed.where(mixed[mixing.PLACE].isNull()).isEmpty()
    plain = packing.pack(documents(spark), word_tokenizer(), with_ids=False).selectExpr("sum(length)").first()[0]
    assert packing.pack(mixed, word_tokenizer(), shard_tokens=4000, with_ids=False, order=mixing.PLACE).selectExpr("sum(length)").first()[0] == plain
