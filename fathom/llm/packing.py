"""Packing by lexical retrieval: BM25 neighbours fill each seed document's window.

Documents are tokenised once and spread over shards of about SHARD_TOKENS tokens. Each shard holds a BM25
inverted index of its documents over the tokenizer's ids, weighted by the whole corpus' document
frequencies (one row per vocabulary entry, so of fixed size). A window begins with a seed, and the
seed's best unused neighbours follow until it is full; the one that doesn't fit is cut, and its rest
seeds the next window. What is left at a shard's end goes into sequences of lengths that are powers of
two, which take no padding.

Defined results: a null or empty text is the end id alone; every id of every row lies in exactly one
piece; rows are told apart even if ids repeat or are null; the number of shards follows the number of
tokens, and a document is never split between shards.

Shards are made by hash, unless the rows carry an order: then they are contiguous ranges of it, and seeds
come in that order, so that sequence ids follow it and only a shard's range bounds how far a neighbour
is drawn forward.
"""

from __future__ import annotations

import math
import re
import zlib
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded

WINDOW = 2048
END_ID = 1
SHARD_TOKENS = 1 << 20
#: BM25.
K1, B = 1.2, 0.75
#: Terms in more than this share of a shard's documents have their weights in full rows instead of lists; the scores are the same.
#: A shard's tokens bound the rows: of SHARD_TOKENS they are 64 MB at most.
DENSE_SHARE = 0.125
_CACHE = 500_000
_LETTERS = re.compile("[a-zß-öø-ÿ]+").fullmatch
_ENDING = r"([a-zß-öø-ÿ])([.,;:!?%$#*&]+)(\s|$)"


class ChunkTokenizer:
    """A word-level tokenizer run once per distinct chunk between ASCII white space.

    Right only for a tokenizer that drops white space and never joins over it, as word_bpe_49k.json:
    its pre-tokenizer splits at white space, and no normalisation form composes over it.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        written = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.letters = {c: written(chr(c))[0][0] for c in range(ord("ß"), 0x100)}  # as the vocabulary writes their bytes
        self._forget()

    def _forget(self):
        """known: chunk to its number; the ids of chunk i are pool[starts[i] : starts[i] + sizes[i]]."""
        self.known: dict[str, int] = {}
        self.pool, self.sizes = np.zeros(0, np.uint16), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> list[int]:
        """The numbers of new chunks.

        Lower-case letters up to U+00FF are one word as they stand, so the model alone sees to them; the rest go as words of their own.
        """
        plain, other, model = [], [], self.tokenizer.model
        for n in new:
            (plain if _LETTERS(n) else other).append(n)
        each = [[t.id for t in model.tokenize(n if n.isascii() else n.translate(self.letters))] for n in plain]
        ids, sizes = [self.pool, np.fromiter(chain.from_iterable(each), np.uint16)], [self.sizes, np.fromiter(map(len, each), np.int64, len(each))]
        for at in range(0, len(other), 8192):
            part = other[at : at + 8192]
            e = self.tokenizer.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(e.ids, np.uint16))
            sizes.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
        self.known.update(zip(chain(plain, other), range(len(self.known), len(self.known) + len(new)), strict=True))
        self.pool, self.sizes = np.concatenate(ids), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes
        return [self.known[n] for n in new]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of the texts, each closed by END_ID."""
        texts = texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string())  # a copy: string kernels misread a slice that was cast
        # both leave the ids as they are: the tokenizer lower-cases, and parts letters from what follows them
        apart = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), pattern=_ENDING, replacement=r"\1 \2\3")
        lists = pc.ascii_split_whitespace(apart)
        chunks = lists.flatten().dictionary_encode()
        names = chunks.dictionary.to_numpy(zero_copy_only=False)
        if len(self.known) > _CACHE:
            self._forget()
        codes = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        if len(new := np.flatnonzero(codes < 0)):
            codes[new] = self._learn(names[new].tolist())
        codes = codes[chunks.indices.to_numpy()]
        lens = self.sizes[codes]
        ends = np.cumsum(lens)
        total = int(ends[-1]) if len(ends) else 0
        body = self.pool[np.repeat(self.starts[codes] - (ends - lens), lens) + np.arange(total)] if total else self.pool[:0]
        bounds = np.concatenate([[0], ends])[np.asarray(lists.offsets) - lists.offsets[0].as_py()]
        ids = np.insert(body, bounds[1:], END_ID).astype(np.uint16)
        return bounds + np.arange(len(bounds)), ids


@lru_cache(2)
def _tokenizer(path: str) -> ChunkTokenizer:
    """One for all tasks of a Python worker, so that what it has learnt is used again."""
    return ChunkTokenizer(path)


def _tokenise(path: str):
    def run(batches):
        tokenizer = _tokenizer(path)
        for batch in batches:
            for part in bounded(batch, 1):
                offsets, ids = tokenizer.encode(part.column(1))
                data = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer((offsets * 2).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), data, pa.array(np.diff(offsets)), *part.columns[2:]], ["doc_id", "ids", "n", *part.schema.names[2:]])

    return run


def tokenised(docs: DataFrame, tokenizer: str, order: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian 16-bit), n (their number, the end id included), and place (the column ``order``, if given)."""
    place = [] if order is None else [F.col(order).cast("long").alias("place")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *place)
    return rows.mapInArrow(_tokenise(tokenizer), "doc_id long, ids binary, n long" + (", place long" if place else ""))


def _terms(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, id, times) of the different ids of documents that lie one after the other, by document and id."""
    keys = np.repeat(np.arange(len(sizes), dtype=np.int64) << 16, sizes)
    keys |= ids
    keys.sort()
    at = np.flatnonzero(np.diff(keys, prepend=-1))
    keys, times = keys[at], np.diff(at, append=len(keys))
    return keys >> 16, keys.astype(np.uint16), times


def _frequencies(batches):
    """(id, documents that have it) of a partition."""
    df = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for part in bounded(batch, 0, 1 << 21):
            docs = [np.frombuffer(ids.as_buffer(), "<u2") for ids in part.column(0)]
            df += np.bincount(_terms(np.concatenate(docs), np.array([len(d) for d in docs]))[1], minlength=1 << 16)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["term", "df"])


def corpus_statistics(tokens: DataFrame) -> tuple[int, int, np.ndarray]:
    """Documents, tokens, and document frequency by id, over the whole corpus."""
    n, total = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(1 << 16, np.int64)
    rows = tokens.select("ids").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in rows.collect():  # one row per vocabulary entry, under 65,536
        df[r["term"]] = r["df"]
    return n, total, df


class Shard:
    """BM25 index of a shard's documents over all their terms, however common; only END_ID, which closes each document, is none."""

    def __init__(self, docs: list[np.ndarray], n_all: int, mean: float, df: np.ndarray):
        self.n = len(docs)
        idf = np.log1p((n_all - df + 0.5) / (df + 0.5))
        sizes = np.array([len(d) for d in docs], np.int64)
        owner, t, tf = _terms(np.concatenate(docs) if docs else np.zeros(0, np.uint16), sizes)
        keep = np.flatnonzero(t != END_ID)
        owner, t, tf = owner[keep], t[keep], tf[keep]
        weight = idf[t] * tf * (K1 + 1) / (tf + (K1 * (1 - B + B * sizes / mean))[owner])
        ends = np.searchsorted(owner, np.arange(self.n), "right").tolist()
        self.query = [t[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        counts = np.bincount(t, minlength=1 << 16)
        common = np.flatnonzero(counts > max(1, DENSE_SHARE * self.n))
        self.row = np.full(1 << 16, -1)
        self.row[common] = np.arange(len(common))
        self.dense, at = np.zeros((len(common), self.n)), self.row[t]
        self.dense[at[at >= 0], owner[at >= 0]] = weight[at >= 0]
        rest = np.flatnonzero(at < 0)
        order = rest[np.argsort(t[rest], kind="stable")]
        self.owner, self.weight = owner[order], weight[order]
        counts[common] = 0
        self.end = np.cumsum(counts)
        self.start = self.end - counts

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best first (ties by position)."""
        t = self.query[seed]
        s = self.start[t]
        lens = self.end[t] - s
        ends = np.cumsum(lens)
        at = np.repeat(s - (ends - lens), lens) + np.arange(int(lens.sum()))
        score = np.bincount(self.owner[at], self.weight[at], self.n).astype(np.float64)  # of no entries it makes longs
        rows = self.row[t]
        for r in rows[rows >= 0].tolist():  # row by row, so that equal documents have equal sums
            score += self.dense[r]
        score *= unused
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


def pack_shard(docs: list[np.ndarray], index: Shard, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length). All but the last few are full."""
    unused = np.ones(len(docs), bool)
    sequences, now, room, first = [], [], window, 0
    queue: list[int] = []

    def put(d: int, start: int) -> int:
        """Puts as much of a document as fits; returns where its rest begins."""
        nonlocal now, room
        take = min(room, len(docs[d]) - start)
        now.append((d, start, take))
        room -= take
        if not room:
            sequences.append(now)
            now, room = [], window
        return start + take

    while True:
        while first < len(docs) and not unused[first]:
            first += 1
        if not queue:
            if first == len(docs):
                break
            queue = [first]
        d = queue.pop(0)
        if not unused[d]:
            continue
        unused[d] = False
        at = 0
        while at < len(docs[d]):
            began = not now
            at = put(d, at)
            if began and now:  # a window of this document's own that it doesn't fill
                queue = index.neighbours(d, unused).tolist()
        if not now:
            queue = []
    if now:  # cut what is left into powers of two
        left, size = now, window
        while left:
            size = 1 << int(math.log2(sum(p[2] for p in left)))
            head, rest, room = [], [], size
            for d, s, n in left:
                if (take := min(room, n)) > 0:
                    head.append((d, s, take))
                    room -= take
                if n > take:
                    rest.append((d, s + take, n - take))
            sequences.append(head)
            left = rest
    return sequences


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packer(n_all: int, total: int, df: np.ndarray, window: int, with_ids: bool):
    mean = max(1.0, total / max(1, n_all))

    def pack(shard: int, rows: list[tuple]):
        docs = [np.frombuffer(ids, "<u2") for _, ids in rows]
        out: list[tuple] = []
        pieces = []
        for k, sequence in enumerate(pack_shard(docs, Shard(docs, n_all, mean, df), window)):
            offset = 0
            for d, s, n in sequence:
                ids = docs[d][s : s + n]
                out.append((rows[d][0], s, n, zlib.crc32(ids.astype("<u4").tobytes()), len(docs[d]), (shard << 32) + k, offset))
                pieces.append(ids)
                offset += n
        columns = [pa.array(c, pa.int64()) for c in zip(*out, strict=True)]
        names = _PIECES.replace(" long", "").split(", ")
        if with_ids:
            columns.append(pa.array([p.astype(np.int32) for p in pieces], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches):
        """Rows (shard, doc_id, ids) sorted by shard; one shard in memory at a time."""
        now, rows = None, []
        for batch in batches:
            for shard, doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if shard != now and rows:
                    yield pack(now, rows)
                    rows = []
                now = shard
                rows.append((doc_id, ids))
        if rows:
            yield pack(now, rows)

    return run


def pack(docs: DataFrame, tokenizer: str, *, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, with_ids: bool = True, order: str | None = None) -> DataFrame:
    """Pieces of packed sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Sequence ids follow the long column ``order`` (see mixing.PLACE) shard by shard, if it is given.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    tokens = scratch.keep(tokenised(docs, tokenizer, order), "tokens")
    n, total, df = corpus_statistics(tokens)
    shards = max(1, math.ceil(total / shard_tokens))
    if order is None:
        # by the ids as well, so that rows with one and the same doc_id don't meet in one shard
        shard, by = F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shards)), []
    else:
        low, high = tokens.agg(F.coalesce(F.min("place"), F.lit(0)), F.coalesce(F.max("place"), F.lit(0))).first()
        shard, by = F.floor((F.coalesce("place", F.lit(low)) - low) / F.lit(-(-(high - low + 1) // shards))).cast("long"), ["place"]
    dealt = tokens.select(shard.alias("shard"), "doc_id", "ids", *by).repartition(F.col("shard")).sortWithinPartitions("shard", *by, F.xxhash64("doc_id"), "doc_id")
    return dealt.select("shard", "doc_id", "ids").mapInArrow(_packer(n, total, df, window, with_ids), _PIECES + (", ids array<int>" if with_ids else ""))
