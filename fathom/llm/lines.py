"""Fuzzy line deduplication.

Lines are normalised (A-Z lower-cased, ASCII punctuation deleted, white space squeezed); equal ones collapse
first. A line's fingerprint consists of blocks: its distinct words are dealt to blocks by hash, and each block
is the SimHash of its own words. A replaced, missing or added word disturbs two blocks at most, so of more
blocks some stay equal, whatever the length of the line (pigeonhole). Lines meet on these:

- under 12 distinct words: 6 blocks, every 4 of them together are a key; under 24: 4 blocks, every 2;
- 24 words and more: a block for every 6 to 12 words, each a key of its own, so the blocks, and the changes that
  they bear, grow with the line.

A key holds three to five words or more (LEVELS). Lines of nearly the next level's length have that level's keys as well.
Lines that meet are verified by edit similarity, first against the smallest of their key, then, where a key
is left with several components, tile by tile; of each connected group the first occurrence stays: the smallest
(doc_id, line number).

Defined results: lines without a letter, digit or non-ASCII character are never dropped; a null text has
no lines; rows equal in id and text count as one document and get the same result; a null id comes first.
"""

from __future__ import annotations

import string
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, Scratch, bounded, fresh, joined_by_size
from .components import components
from .simhash import _mixed

SIMILARITY = 0.8
#: Distinct words from which a level begins, its blocks, how many of them make a key, and the words that a key must hold: few
#: words are often all common ones, and lines that share no more are hardly ever alike. Beyond, the first two double.
LEVELS = ((3, 6, 4, 3), (12, 4, 2, 4), (24, 4, 1, 5))
#: A line of this share of the next level's words has that level's keys too.
MARGIN = 0.9
#: Lines that share a key are verified in tiles of this many, each pair of tiles on its own.
TILE = 64
_PIECE = 12
_PUNCTUATION = string.punctuation.encode()


def levenshtein(a: str, b: str, most: int | None = None) -> int:
    """Edit distance, by bit vectors (Myers): one big-integer step per character of b. Above ``most`` any number above it."""
    if not a or not b:
        return len(a) or len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top, distance, left = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a), len(b)
    plus, minus = full, 0
    for c in b:
        eq = where.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(d | plus)), plus & d
        if up & top:
            distance += 1
        if down & top:
            distance -= 1
        left -= 1
        if most is not None and distance - left > most:
            return distance - left
        up, down = (up << 1 | 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(x | up)), up & x
    return distance


def _alike(a: str, b: str) -> int:
    """Length of the common beginning."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:  # a[:low] == b[:low], a[:high] != b[:high]
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def at_most(a: str, b: str, enough: int = 0, exact: int = 0) -> int:
    """An upper bound of the edit distance: what stays when common ends, and common pieces amid the rest, are taken out.

    Gives up above ``enough``, if that is given, with a number above it. Rests of up to ``exact`` characters count
    by their edit distance, others by their length.
    """
    todo, total = [(a, b)], 0
    while todo:
        a, b = todo.pop()
        at = _alike(a, b)
        a, b = a[at:], b[at:]
        if a and b and (end := _alike(a[::-1], b[::-1])):
            a, b = a[:-end], b[:-end]
        n, off = len(a), abs(len(a) - len(b))
        for at in (n // 2 - _PIECE // 2, n // 4, 3 * n // 4 - _PIECE) if min(n, len(b)) > _PIECE else ():
            if (p := b.find(a[at : at + _PIECE], max(0, at - off - _PIECE), at + off + 2 * _PIECE)) >= 0:
                todo += [(a[:at], b[:p]), (a[at + _PIECE :], b[p + _PIECE :])]
                break
        else:
            total += levenshtein(a, b) if max(n, len(b)) <= exact else max(n, len(b))
            if enough and total > enough:
                return total
    return total


def _room(a: str, b: str, least: float = SIMILARITY) -> int:
    """The edits that two lines of a similarity may be apart."""
    return int((1 - least) * max(len(a), len(b)) + 1e-9)


def similar(a: str, b: str, least: float = SIMILARITY) -> bool:
    """1 - distance / length of the longer >= least."""
    most = _room(a, b, least)
    if abs(len(a) - len(b)) > most:
        return False
    enough = max(1, most)
    return at_most(a, b, enough) <= most or at_most(a, b, enough, exact=64) <= most or levenshtein(a, b, most) <= most


_FACTOR = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2 ** 64
_SPAN = 1 << 18


def _powers(x: int, n: int) -> np.ndarray:
    out = np.full(n, x, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(int(_FACTOR), _SPAN + 1), _powers(pow(int(_FACTOR), -1, 1 << 64), _SPAN + 1)


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text that has single spaces only: a polynomial over the bytes, mixed.

    All words at once, from running sums; a text longer than _SPAN is taken in pieces that end between words.
    """
    if len(text) > _SPAN:
        parts, at = [], 0
        while at < len(text):
            end = len(text) if len(text) - at <= _SPAN else text.rfind(b" ", at, at + _SPAN)
            if end <= at:  # a word of _SPAN or more
                end = found if (found := text.find(b" ", at)) > 0 else len(text)
            piece, at = text[at:end], end + 1
            parts.append(word_hashes(piece) if len(piece) <= _SPAN else np.array([xxhash.xxh64_intdigest(piece)], np.uint64))
        return np.concatenate(parts)
    x = np.frombuffer(text, np.uint8)
    gaps = np.flatnonzero(x == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(x))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _UP[: len(x)], dtype=np.uint64)])
        return _mixed((sums[ends] - sums[starts]) * _DOWN[starts], 1)


def levels_of(n: np.ndarray) -> np.ndarray:
    """The level of lines by their number of distinct words."""
    begins = LEVELS[-1][0]
    return np.searchsorted([low for low, *_ in LEVELS[1:]], n, "right") + np.where(n >= begins, np.log2(np.maximum(n, begins) / begins), 0).astype(np.int64)


def _blocks(h: np.ndarray, slot: np.ndarray, n_slots: int) -> tuple[np.ndarray, np.ndarray]:
    """SimHash and number of the words of each slot; a bit is 1 if set in over half of them."""
    order = np.argsort(slot, kind="stable")
    size = np.bincount(slot, minlength=n_slots)
    out, used = np.zeros(n_slots, np.uint64), np.flatnonzero(size)
    if len(used):
        bits = np.unpackbits(h[order].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        at = (np.cumsum(size) - size)[used]
        # where a byte holds every count, eight of them are added as one long
        ones = np.add.reduceat(bits.view(np.uint64), at, axis=0).view(np.uint8) if size.max() < 256 else np.add.reduceat(bits, at, axis=0, dtype=np.int64)
        out[used] = np.packbits(ones > (size[used, None] // 2).astype(ones.dtype), axis=1, bitorder="little").reshape(-1).view(np.uint64)
    return out, size


def _keys(h: np.ndarray, line: np.ndarray, n_lines: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, key) of lines given as their distinct words' hashes."""
    n = np.bincount(line, minlength=n_lines)
    level = levels_of(n)
    nearly = np.flatnonzero(levels_of(np.ceil((n + 1) / MARGIN) - 1) > level)  # have the next level's keys as well
    who, level = np.concatenate([np.arange(n_lines), nearly]), np.concatenate([level, level[nearly] + 1])
    last = len(LEVELS) - 1
    g = np.where(level < last, np.array([b for _, b, *_ in LEVELS])[np.minimum(level, last)], LEVELS[-1][1] << np.maximum(level - last, 0))
    first = np.cumsum(g) - g
    again = np.full(n_lines, -1)
    again[nearly] = np.arange(n_lines, len(who))
    twice = again[line] >= 0
    words, of = np.concatenate([h, h[twice]]), np.concatenate([line, again[line[twice]]])
    block, size = _blocks(words, first[of] + (_mixed(words, 2) % g[of].astype(np.uint64)).astype(np.int64), int(g.sum()))
    owner = np.repeat(np.arange(len(who)), g)
    with np.errstate(over="ignore"):
        named = _mixed(block + _FACTOR * (np.arange(len(block)) - first[owner] + 1000 * g[owner]).astype(np.uint64), 3)
        alone = (level[owner] >= last) & (size >= LEVELS[-1][3])
        lines, keys = [who[owner[alone]]], [named[alone]]
        for i, (_, blocks, k, least) in enumerate(LEVELS[:-1]):
            mine = np.flatnonzero(level == i)
            at = first[mine][:, None] + np.arange(blocks)
            for j, some in enumerate(combinations(range(blocks), k)):
                full = size[at[:, some]].sum(axis=1) >= least
                lines.append(who[mine[full]])
                keys.append(_mixed(named[at[full][:, some]].sum(axis=1, dtype=np.uint64) + np.uint64(j), 4))
    return np.concatenate(lines), np.concatenate(keys)


def line_keys(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, keys) of (non-empty) normalised lines: the keys of line i are keys[offsets[i] : offsets[i + 1]]."""
    sizes = np.fromiter((x.count(b" ") + 1 for x in lines), np.int64, len(lines))
    who, keys, ends, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], np.cumsum(sizes), 0
    while at < len(lines):  # bounded slices: 64 bytes a word
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 50_000)))
        words = np.repeat(np.arange(to - at, dtype=np.uint64), sizes[at:to]) << np.uint64(44) | word_hashes(b" ".join(lines[at:to])) >> np.uint64(20)
        words.sort()
        words = words[np.concatenate([[True], words[1:] != words[:-1]])]
        w, k = _keys(_mixed(words & np.uint64((1 << 44) - 1), 1), (words >> np.uint64(44)).astype(np.int64), to - at)
        who.append(w + at)
        keys.append(k)
        at = to
    line, key = np.concatenate(who), np.concatenate(keys)
    order = np.argsort(line, kind="stable")
    return np.concatenate([[0], np.cumsum(np.bincount(line, minlength=len(lines)))]), key[order]


def _normalised(text: str | None) -> list[tuple[int, bytes]]:
    """(number, normalised line) of the lines that have something left."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower().translate(None, _PUNCTUATION)
    return [(k, b" ".join(w)) for k, x in enumerate(raw.split(b"\n")) if (w := x.split())]


def _hashed(batches):
    for batch in batches:
        for part in bounded(batch, 2, 1 << 20):
            found = [(i, k, x) for i, text in enumerate(part.column(2)) for k, x in _normalised(text.as_py())]
            row, no, norm = zip(*found, strict=True) if found else ((), (), ())
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in norm), "<i8").reshape(-1, 2)
            offsets, keys = line_keys(norm)
            at = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).take(at), part.column(1).take(at), pa.array(no, pa.int32()), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.view(np.int64))), pa.array([x.decode("utf-8", "replace") for x in norm], pa.string()),
                ],
                ["rid", "doc_id", "line", "k1", "k2", "keys", "norm"],
            )


@F.arrow_udf(T.BooleanType())
def _verified(x: pa.Array, y: pa.Array) -> pa.Array:
    return pa.array([similar(a.as_py(), b.as_py()) for a, b in zip(x, y, strict=True)], pa.bool_())


def _tiles(batches):
    """Edges of lines (key, i, j, t, id, c, norm), sorted by tile pair (key, i, j)."""
    now, rows = None, []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r[:3] != now and rows:
                yield from _pairs(now, rows)
                rows = []
            now = r[:3]
            rows.append(r[3:])
    if rows:
        yield from _pairs(now, rows)


def _pairs(tile, rows):
    """A forest over the similar pairs between (or, on the diagonal, inside) two tiles; pairs already joined are not tested.

    Of two components the distance of their first lines is found, which by the triangle inequality rules out most
    pairs of lines near to these.
    """
    members: dict[int, list] = {}
    for t, i, c, x in rows:
        of = members.setdefault(c, [])
        of.append((t, i, x, at_most(of[0][2], x) if of else 0))
    root, edges = {c: c for c in members}, []

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for c, d in combinations(members, 2):
        if (p := find(c)) == (q := find(d)):
            continue
        pairs = [(x, y) for x in members[c] for y in members[d] if tile[1] == tile[2] or x[0] != y[0]]
        apart = levenshtein(members[c][0][2], members[d][0][2]) if len(pairs) > 1 else 0
        for (_, i, x, u), (_, j, y, v) in pairs:
            if apart - u - v <= _room(x, y) and similar(x, y):
                root[p] = q
                edges.append((i, j))
                break
    if edges:
        a, b = zip(*edges, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _groups(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of the distinct lines, named by k1, that have a similar one."""
    postings = lines.select(F.explode("keys").alias("key"), F.col("k1").alias("id"))
    # occurrences of one line have one id, so copies collapse in the partial aggregation
    shared = scratch.keep(postings.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "first"), "shared")
    members = scratch.keep(joined_by_size(postings, shared, "key").distinct(), "members")
    scratch.drop(shared)
    texts = lines.select(F.col("k1").alias("id"), "norm")
    texts = scratch.keep(joined_by_size(texts, members.select("id").distinct(), "id").groupBy("id").agg(F.min("norm").alias("norm")), "texts")
    stars = members.where("first < id").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    x, y = texts.toDF("a", "x"), texts.toDF("b", "y")
    edges = scratch.keep(stars.join(x, "a").join(y, "b").where(_verified("x", "y")).select("a", "b"), "stars")
    found = scratch.keep(components(edges, scratch), "found")

    placed = members.select("key", "id").join(found, F.col("id") == F.col("node"), "left").select("key", "id", F.coalesce("component", "id").alias("c"))
    each = placed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("low"), F.max("c").alias("high"), F.bit_xor(F.xxhash64("id")).alias("all"))
    # of keys with the very same lines one is enough
    still = each.where("low < high").groupBy("m", "all").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("m") / F.lit(TILE)).cast("int").alias("s"))
    still = scratch.keep(placed.join(still, "key"), "open")
    if still.isEmpty():
        return found
    tiled = still.withColumn("t", F.pmod(F.xxhash64("id"), F.col("s")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    tiled = tiled.join(texts, "id").select("key", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "id", "c", "norm")
    rest = tiled.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "id").mapInArrow(_tiles, "a long, b long")
    # written first, so that a task has one Python worker at a time
    return components(edges.union(scratch.keep(rest, "rest")), scratch)


def dropped_lines(docs: DataFrame) -> DataFrame:
    """(rid, lines): the numbers, from 0, of the lines that each document loses; documents that lose none are left out.

    rid is xxhash64(doc_id, text).
    """
    scratch = Scratch(docs.sparkSession, "lines")
    text, doc_id = F.col("text").cast("string"), F.col("doc_id").cast("long")
    source = docs.select(F.xxhash64(doc_id, text).alias("rid"), doc_id.alias("doc_id"), text.alias("text"))
    lines = scratch.keep(source.mapInArrow(_hashed, "rid long, doc_id long, line int, k1 long, k2 long, keys array<long>, norm string"), "lines")
    groups = _groups(lines, scratch)
    at = F.struct("doc_id", "line", "rid")
    firsts = lines.groupBy("k1", "k2").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = scratch.keep(firsts.join(groups, F.col("k1") == F.col("node"), "left").where("n > 1 OR component IS NOT NULL").select("k1", "k2", "first", "component"), "firsts")
    best = firsts.where("component IS NOT NULL").groupBy("component").agg(F.min("first").alias("best"))
    kept = joined_by_size(firsts, scratch.keep(best, "best"), "component", "left").select("k1", "k2", F.coalesce("best", "first").alias("first"))
    gone = lines.select("k1", "k2", "rid", "line", at.alias("own")).join(kept, ["k1", "k2"]).where(F.col("own") != F.col("first"))
    # rows equal in id and text share a rid and a line number: what one keeps the other keeps
    gone = gone.where("rid <> first.rid OR line <> first.line").groupBy("rid").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    return scratch.only(scratch.keep(gone, "gone"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines and the numbers of the lines lost, of every document; texts are left out of the join."""
    rid = F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    n_lines = F.coalesce(F.size(F.split(F.col("text").cast("string"), "\n")), F.lit(0)).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), rid.alias("rid"), n_lines.alias("n_lines"))
    return rows.join(dropped_lines(docs), "rid", "left").select("doc_id", "n_lines", F.coalesce("lines", F.array().cast("array<int>")).alias("lines"))


def with_dropped(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents with a column (its name is given back) of the line numbers they lose, null for none.

    These lists are broadcast if all of them together are small, so that no text is shuffled.
    """
    rid, lost = fresh("rid", docs.columns), fresh("lost", docs.columns)
    gone = dropped_lines(docs).select(F.col("rid").alias(rid), F.col("lines").alias(lost))
    rows, numbers = gone.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(lost)), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and numbers <= 4 * BROADCAST_ROWS:
        gone = F.broadcast(gone)
    keyed = docs.withColumn(rid, F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    return keyed.join(gone, rid, "left").drop(rid), lost


def _without_lines(text: str, lost: str):
    """The text without its lost lines (sorted numbers), in the JVM: a byte of marks for every line up to the last lost.

    Lines and marks are bound to a variable, so that neither is made anew for each line.
    """
    marks = f"array_join(transform(`{lost}`, (x, i) -> concat(repeat('0', x - coalesce(get(`{lost}`, i - 1), -1) - 1), '1')), '')"
    bound = f"array(struct(split({text}, '\\n', -1) AS lines, cast({marks} AS binary) AS marks))"
    return F.expr(f"get(transform({bound}, s -> array_join(filter(s.lines, (x, i) -> substring(s.marks, i + 1, 1) <> X'31'), '\\n')), 0)")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents without their dropped lines, all columns kept; n_chars, if there, follows the text.

    A document that loses every line it had is a copy as a whole and goes; one that was empty stays.
    """
    marked, lost = with_dropped(docs)
    text = fresh("cleaned", marked.columns)
    whole = F.col("text").cast("string")
    out = marked.withColumn(text, F.when(F.col(lost).isNull(), whole).otherwise(_without_lines("cast(text as string)", lost)))
    out = out.where(F.col(lost).isNull() | (F.length(F.trim(F.col(text), F.lit(" \t\n\r"))) > 0))
    columns = [
        F.col(text).alias("text") if c == "text" else F.length(text).cast(out.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)
        for c in docs.columns
    ]
    return out.select(*columns)
