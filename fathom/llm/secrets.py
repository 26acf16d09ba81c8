"""Secret scanning: fixed patterns, and a battery of randomness tests over all other long tokens.

One pass over the texts finds the pattern spans and tests every token of TOKEN, of a path its parts as well. A
token's encoding is the smallest alphabet that holds it. Three tests ask whether it looks like uniform draws
from that alphabet: chi-squared uniformity, runs about the alphabet's middle, and serial correlation; a
token that fails one is no candidate.

What is left is held against ordinary text, test by test, each calibrated for the encoding and for as many characters
as the token has: runs by how often it changes its class of characters (ordinary words and numbers stay in theirs),
uniformity by its letters' frequencies, serial correlation by its pairs of letters. The frequencies are those of the
corpus' own words of under 16 characters, all of them counted. Each is a likelihood ratio of uniform draws over
ordinary text given the ones before, so their product is an e-value; it grows with length by itself. The
e-values of all tokens of the corpus go through the e-BH procedure, which holds the false-discovery rate at FDR
under any dependence.

Defined results: a null or empty text has no spans; equal rows get equal results; ids may be null or
repeated. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, bounded

#: The base patterns with the least length of what counts, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
_HINTS = ("passw", "secret", "token", "api")

TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])")
#: Characters of a token; shorter words are ordinary text.
LEAST = 16
FDR = 0.001
#: A uniform token passes all three tests with probability of at least 1 - 3 * ALPHA.
ALPHA = 0.001
#: The null: ordinary text stays in its class of characters with this probability at each step; after a
#: capital, another capital and a small letter are as likely and have AFTER_CAPITAL each.
STAY, AFTER_CAPITAL = 0.8, 0.45
PRIOR = 500
BINS_PER_NAT, MAX_NATS = 4, 256

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets, smallest first where one holds another, each with its weight among secrets (they sum to one).
ENCODINGS = (
    ("decimal", DIGITS, 0.02),
    ("hex", DIGITS + "abcdef", 0.05),
    ("hex_upper", DIGITS + "ABCDEF", 0.05),
    ("base32", UPPER + "234567", 0.05),
    ("lower", LOWER, 0.02),
    ("upper", UPPER, 0.02),
    ("base36", DIGITS + LOWER, 0.07),
    ("base36_upper", DIGITS + UPPER, 0.04),
    ("base62", DIGITS + UPPER + LOWER, 0.28),
    ("base64", UPPER + LOWER + DIGITS + "+/", 0.28),
    ("base64url", UPPER + LOWER + DIGITS + "-_", 0.12),
)
_RANKS = [(name, {c: i for i, c in enumerate(sorted(chars))}) for name, chars, _ in ENCODINGS]


def _kind_of_char(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


_SHARES = [[sum(_kind_of_char(c) == k for c in ranks) / len(ranks) for k in range(4)] for _, ranks in _RANKS]


def encoding_of(token: str) -> int | None:
    """Index of the smallest encoding whose alphabet holds the token; None if there is none."""
    chars = set(token)
    return next((i for i, (_, ranks) in enumerate(_RANKS) if chars <= ranks.keys()), None)


def _tail(z: float) -> float:
    """Two-sided normal tail."""
    return math.erfc(abs(z) / math.sqrt(2))


def battery(ranks: list[int], size: int) -> tuple[float, float, float]:
    """p-values of chi-squared uniformity, runs, and serial correlation of a token's symbol ranks."""
    n = len(ranks)
    counts: dict[int, int] = {}
    for r in ranks:
        counts[r] = counts.get(r, 0) + 1
    e = n / size
    chi = sum((c - e) ** 2 / e for c in counts.values()) + (size - len(counts)) * e
    df = size - 1
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))  # Wilson-Hilferty
    uniform = 0.5 * math.erfc(z / math.sqrt(2))
    high = [2 * r >= size for r in ranks]
    a = sum(high)
    b = n - a
    if a and b:
        runs = 1 + sum(x != y for x, y in zip(high, high[1:], strict=False))
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / max(1, n - 1)
        p_runs = _tail((runs - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    m = sum(ranks) / n
    ss = sum((r - m) ** 2 for r in ranks)
    serial = sum((x - m) * (y - m) for x, y in zip(ranks, ranks[1:], strict=False)) / ss if ss else 1.0
    return uniform, p_runs, _tail((serial + 1 / n) * math.sqrt(n))


class Ordinary:
    """Letters of ordinary text: log frequencies, and log frequencies after another letter (case is left out).

    Half of a letter's weight after another is its plain frequency, and a tenth of that is shared out evenly, so that
    no rare pair of letters says much by itself. All letters begin alike, with PRIOR counts each, so a few words of
    text say next to nothing.
    """

    def __init__(self, pairs: np.ndarray):
        """``pairs``: 26 x 26 counts of neighbouring letters."""
        after = pairs.sum(axis=0)
        plain = 0.9 * (after + PRIOR) / (after.sum() + 26 * PRIOR) + 0.1 / 26
        bigram = (pairs + PRIOR * plain) / (pairs.sum(axis=1, keepdims=True) + PRIOR)
        self.plain = np.log(plain).tolist()
        self.paired = np.log(0.5 * bigram + 0.5 * plain).tolist()


def evidence(body: str, ordinary: Ordinary) -> tuple[float, float, float]:
    """Nats for random over ordinary from runs, uniformity and serial correlation of a token without padding."""
    at = encoding_of(body)
    if at is None:
        return 0.0, 0.0, 0.0
    share, present = _SHARES[at], sum(s > 0 for s in _SHARES[at])
    kinds = [_kind_of_char(c) for c in body]
    cased = share[1] > 0 and share[2] > 0

    def stays(a: int, b: int) -> float:
        if a == 2 and cased:
            return AFTER_CAPITAL if b in (1, 2) else (1 - 2 * AFTER_CAPITAL) / (present - 2)
        return STAY if a == b else (1 - STAY) / (present - 1)

    runs = 0.0
    if present > 1:
        runs = math.log(share[kinds[0]] * present) + sum(math.log(share[b] / stays(a, b)) for a, b in zip(kinds, kinds[1:], strict=False))
    letters = [ord(c) - 65 & 31 if k in (1, 2) else None for c, k in zip(body, kinds, strict=True)]
    even = -math.log(26)
    uniform = sum(even - ordinary.plain[x] for x in letters if x is not None)
    serial = sum(ordinary.plain[y] - ordinary.paired[x][y] for x, y in zip(letters, letters[1:], strict=False) if x is not None and y is not None)
    return runs, uniform, serial


def log_e_value(token: str, ordinary: Ordinary) -> float:
    """Nats of evidence that a token is random in its encoding, whose weight pays for the choice among them."""
    body = token.rstrip("=")
    at = encoding_of(body)
    return 0.0 if at is None else max(0.0, sum(evidence(body, ordinary)) + math.log(ENCODINGS[at][2]))


def passes(token: str) -> bool:
    """Whether none of the three tests rules out uniform draws."""
    body = token.rstrip("=")
    at = encoding_of(body)
    if at is None:
        return False
    ranks = _RANKS[at][1]
    return min(battery([ranks[c] for c in body], len(ranks))) >= ALPHA


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, str]], int]:
    """Base spans (start, kind, end), tokens outside them that pass the battery (start, end, token), and tokens tested.

    A path is tested as a whole and part by part.
    """
    text = text or ""
    spans = []
    low = text.lower()
    if any(h in low for h in _HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    spans.sort()
    starts, ends = [s for s, _, _ in spans], [0, *accumulate((e for _, _, e in spans), max)]
    found, tested = [], 0
    for m in TOKEN.finditer(text):
        pieces = [(m.start(), m.end())]
        if "/" in m[0]:
            pieces += [(m.start() + p.start(), m.start() + p.end()) for p in re.finditer(r"[^/]{%d,}" % LEAST, m[0]) if p[0] != m[0]]
        for s, e in pieces:
            tested += 1
            if ends[bisect_left(starts, e)] <= s and passes(text[s:e]):
                found.append((s, e, text[s:e]))
    return spans, found, tested


_CLASS = np.zeros(256, np.uint8)  # letters from 1, other characters of tokens 27, all else parts words
_CLASS[[ord(c) for c in DIGITS + "+/_-"]] = 27
for _i, _c in enumerate(LOWER):
    _CLASS[[ord(_c), ord(_c.upper())]] = _i + 1


def letter_pairs(texts) -> np.ndarray:
    """28 x 28 counts of neighbours in words of under LEAST characters."""
    x = _CLASS[np.frombuffer(b" ".join((t or "").encode("utf-8", "surrogatepass") for t in texts), np.uint8)]
    edges = np.concatenate([[-1], np.flatnonzero(x == 0), [len(x)]])
    for at in np.flatnonzero(np.diff(edges) > LEAST):
        x[edges[at] + 1 : edges[at + 1]] = 0
    return np.bincount(x[:-1].astype(np.int64) * 28 + x[1:], minlength=28 * 28) if len(x) > 1 else np.zeros(28 * 28, np.int64)


def _pairs(batches):
    total = np.zeros(28 * 28, np.int64)
    for batch in batches:
        for part in bounded(batch, 0, 1 << 22):
            total += letter_pairs(part.column(0).to_pylist())
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["pair", "n"])


def ordinary_text(docs: DataFrame) -> Ordinary:
    """From the words of all documents; at most 784 sums reach the driver."""
    pairs = np.zeros(28 * 28, np.int64)
    for r in docs.select(F.col("text").cast("string")).mapInArrow(_pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():
        pairs[r["pair"]] = r["n"]
    return Ordinary(pairs.reshape(28, 28)[1:27, 1:27])


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])
_TOKEN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("token", T.StringType())])
_CANDIDATE = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("nats", T.DoubleType())])
_SCAN = T.StructType([T.StructField("base", T.ArrayType(_SPAN)), T.StructField("tokens", T.ArrayType(_TOKEN)), T.StructField("tested", T.LongType())])
_ARROW = pa.struct([
    ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
    ("tokens", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("token", pa.string())]))),
    ("tested", pa.int64()),
])


@F.arrow_udf(_SCAN)
def scanned(texts: pa.Array) -> pa.Array:
    """scan() over a batch of whole texts."""
    out = []
    for t in texts:
        base, found, tested = scan(t.as_py())
        out.append({
            "base": [{"start": s, "kind": k, "end": e} for s, k, e in base],
            "tokens": [{"start": s, "end": e, "token": t} for s, e, t in found],
            "tested": tested,
        })
    return pa.array(out, _ARROW)


def weighed(tokens: list[tuple[int, int, str]], ordinary: Ordinary) -> list[tuple[int, int, float]]:
    """(start, end, nats) of tokens with evidence; of a path and its parts what has most of it, no two overlapping."""
    out: list[tuple[int, int, float]] = []
    for s, e, nats in sorted(((s, e, n) for s, e, t in tokens if (n := log_e_value(t, ordinary)) > 0), key=lambda x: (-x[2], x[0])):
        at = bisect_left(out, (s,))
        if (at == len(out) or out[at][0] >= e) and (at == 0 or out[at - 1][1] <= s):
            out.insert(at, (s, e, nats))
    return out


def _weigher(ordinary: Ordinary):
    @F.arrow_udf(T.ArrayType(_CANDIDATE))
    def run(tokens: pa.Array) -> pa.Array:
        each = ([(x["start"], x["end"], x["token"]) for x in t.as_py() or ()] for t in tokens)
        return pa.array([[{"start": s, "end": e, "nats": n} for s, e, n in weighed(t, ordinary)] for t in each], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("nats", pa.float64())])))

    return run


def threshold(rows: DataFrame, fdr: float = FDR) -> float:
    """Least nats that e-BH accepts over all tokens tested; infinite if it accepts none.

    The largest k with e_(k) >= tested / (fdr * k); a bin counts by its lower edge, which is on the safe side.
    """
    tested = rows.agg(F.sum("tested")).first()[0] or 0
    bins = F.least(F.floor(F.col("c.nats") * BINS_PER_NAT), F.lit(BINS_PER_NAT * MAX_NATS))
    counts = rows.select(F.explode("candidates").alias("c")).groupBy(bins.alias("bin")).count().collect()  # at most BINS_PER_NAT * MAX_NATS + 1 rows
    k, accepted = 0, math.inf
    for r in sorted(counts, key=lambda r: -r["bin"]):
        k += r["count"]
        if r["bin"] / BINS_PER_NAT >= math.log(tested) - math.log(fdr * k):
            accepted = r["bin"] / BINS_PER_NAT
    return accepted


def find_secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, base (array of start, kind, end), found (the same, the battery's) of every row."""
    scratch = Scratch(docs.sparkSession, "secrets")
    found = scratch.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), scanned(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*"), "scanned")
    weigh = _weigher(ordinary_text(docs))
    rows = scratch.keep(found.select("doc_id", "base", weigh("tokens").alias("candidates"), "tested"), "weighed")
    scratch.drop(found)
    least = threshold(rows, fdr)
    taken = F.filter("candidates", lambda c: c["nats"] >= F.lit(least))
    as_span = F.transform(taken, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))
    return rows.select("doc_id", "base", as_span.alias("found"))


def joined(spans) -> F.Column:
    """kind:start:end of each span by start, then kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
