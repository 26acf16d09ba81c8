import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fathom.llm import packing
from fathom.llm.registry import word_tokenizer

from .odd import documents, empty, rows

TEXTS = ["", None, " \n", "Hello, World!! x.y", "ab.. cd,e f!\n g?!́ ×. é́, É! ok. x word, y", "<|endoftext|> a<|startoftext|>. don't WE'LL 'S 12's", "İΣΣ K. ﬁ 日本語, テスト。", "a\x0bb\x0cc\x1cd\x85e", "x " * 3000]


def reference(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_tokenizer())
    return [e.ids + [1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_chunks_give_the_tokenizers_ids():
    t = packing.ChunkTokenizer(word_tokenizer())
    texts = TEXTS + [r[1] for r in rows()]
    for part in (texts, texts[3:], texts):
        sliced = pa.array(["lead"] + part, pa.string()).slice(1)
        offsets, ids = t.encode(sliced)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == reference(part)


def test_accented_words_go_to_the_model_alone():
    """What the whole tokenizer sees costs several times as much, and half of the words of some languages have an accent."""

    class Spy:
        def __init__(self, tokenizer):
            self.tokenizer, self.model, self.seen = tokenizer, tokenizer.model, []

        def encode(self, words, **options):
            self.seen += words
            return self.tokenizer.encode(words, **options)

    t = packing.ChunkTokenizer(word_tokenizer())
    t.tokenizer = spy = Spy(t.tokenizer)
    letters = [chr(c) for c in range(0xDF, 0x100) if c != 0xF7]
    texts = ["straße, élève. ciónñß! übergrößen", " ".join(letters), " ".join(f"a{x}b {x}{x}c ab{x}," for x in letters), "a÷b ÀÉ Åse µg x\u0301 ﬁn"]
    offsets, ids = t.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == reference(texts)
    assert sorted(spy.seen) == sorted(["!", ",", ".", "a÷b", "ÀÉ", "Åse", "µg", "x\u0301", "ﬁn"])


def test_terms_of_documents():
    docs = [np.array(x, np.uint16) for x in ([7, 5, 7, 1], [1], [65535, 0, 65535, 1], [5, 1])]
    want = [(i, int(t), int(n)) for i, d in enumerate(docs) for t, n in zip(*np.unique(d, return_counts=True))]
    got = packing._terms(np.concatenate(docs), np.array([len(d) for d in docs]))
    assert list(zip(*(x.tolist() for x in got))) == want
    assert [len(x) for x in packing._terms(np.zeros(0, np.uint16), np.zeros(0, np.int64))] == [0, 0, 0]
    batches = [pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d in part], pa.binary())], ["ids"]) for part in (docs, docs[:1])]
    (rows,) = packing._frequencies(batches)
    assert dict(zip(rows["term"].to_pylist(), rows["df"].to_pylist())) == {0: 1, 1: 5, 5: 3, 7: 2, 65535: 1}


@pytest.mark.parametrize("shard_tokens", [1 << 20, 4000])
def test_every_id_lies_in_one_piece(spark, shard_tokens):
    docs = documents(spark)
    got = packing.pack(docs, word_tokenizer(), shard_tokens=shard_tokens).collect()
    want = sorted(map(tuple, reference([r[1] for r in rows()])))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in got:
        assert p["ids_crc32"] == zlib.crc32(np.array(p["ids"], "<u4").tobytes()) and p["length"] == len(p["ids"]) > 0
        by_doc[p["doc_id"], p["doc_tokens"]].append(p)
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    lengths = [sum(n for _, n in s) for s in by_sequence.values()]
    padding = sum(2048 - n for n in lengths if n & (n - 1))
    assert padding == 0
    whole = []
    for (_, n), pieces in by_doc.items():
        pieces.sort(key=lambda p: p["start"])
        copies = sum(p["length"] for p in pieces) // n
        assert sum(p["length"] for p in pieces) == copies * n
        if copies == 1:
            whole.append(tuple(i for p in pieces for i in p["ids"]))
    assert set(whole) <= set(want) and sum(lengths) == sum(map(len, want))


def test_neighbours_share_words():
    texts = ["apple banana cherry " * 20, "zebra yak xerus " * 20, "apple banana cherry date " * 15, "zebra yak walrus " * 20]
    t = packing.ChunkTokenizer(word_tokenizer())
    offsets, ids = t.encode(pa.array(texts))
    docs = [ids[a:b] for a, b in zip(offsets, offsets[1:])]
    df = np.zeros(1 << 16, np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    index = packing.Shard(docs, 1000, 60.0, df)
    assert index.neighbours(0, np.array([False, True, True, True])).tolist() == [2]
    assert index.neighbours(1, np.array([True, False, True, True]))[0] == 3


def bm25(docs, seed, n_all, mean, df):
    """The plain form: the score of each document by every term it shares with the seed."""
    out = []
    for d in docs:
        score = 0.0
        for t in (set(docs[seed].tolist()) & set(d.tolist())) - {packing.END_ID}:
            tf = int((d == t).sum())
            score += np.log1p((n_all - df[t] + 0.5) / (df[t] + 0.5)) * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(d) / mean))
        out.append(score)
    return np.array(out)


def test_common_terms_find_neighbours():
    rng = np.random.default_rng(3)
    docs = [np.append(rng.choice([5, 6, 7, 8, *range(100, 160)], rng.integers(2, 30), p=[0.1] * 4 + [0.01] * 60), 1).astype(np.uint16) for _ in range(60)]
    docs += [np.array(x, np.uint16) for x in ([5, 6, 1], [5, 1], [6, 6, 1], [200, 1], [1])]  # only the terms of most documents, one of no other, none
    df = np.zeros(1 << 16, np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    mean = sum(map(len, docs)) / len(docs)
    index, every = packing.Shard(docs, len(docs), mean, df), np.ones(len(docs), bool)
    for seed in range(len(docs)):
        want, got = bm25(docs, seed, len(docs), mean, df), index.neighbours(seed, every)
        assert set(got.tolist()) == set(np.flatnonzero(want > 0).tolist())
        assert np.all(np.diff(want[got]) <= 1e-9)
    assert {61, 62} <= set(index.neighbours(60, every).tolist()) and index.neighbours(64, every).size == 0


def test_empty_table(spark):
    assert packing.pack(empty(spark), word_tokenizer()).count() == 0
