"""Quality rules as a bitmask ledger.

Every rule is measured and evaluated once per document in one pass over the text. The ledger keeps
the measurements and a bit per failed rule; a policy is a named mask over those bits, so changing a
policy, comparing two versions of it, or asking what a rule contributes never reads a text again.

Defined results: a null or empty text has no words, fails ``few_words`` and nothing else; repeated
rows are judged row by row; extra input columns are carried only by :func:`apply_policy`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import islice
from operator import eq, or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

#: ASCII white space, and the characters counted as symbols.
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
_NOT_LETTERS = bytes(i for i in range(128) if not chr(i).isalpha())
_NOT_UPPER = bytes(i for i in range(256) if not 65 <= i <= 90)

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_echoes")
_SCHEMA = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])


@dataclass(frozen=True)
class Rule:
    """A rule fails where its condition over the measurements holds."""

    name: str
    bit: int
    fails: str


#: The first two are the base rules. n_upper counts A-Z, n_echoes words equal to the word before.
RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbol_heavy", 2, "10 * n_symbols > n_words"),
    Rule("duplicate_lines", 3, "n_lines >= 6 AND 2 * n_dup_lines > n_lines"),
    Rule("long_words", 4, "word_chars > 20 * n_words"),
    Rule("few_letters", 5, "3 * n_letters < word_chars"),
    Rule("shouting", 6, "2 * n_upper > word_chars"),
    Rule("echoes", 7, "4 * n_echoes > n_words"),
)

#: A policy rejects a document that fails any rule in its mask.
POLICIES = {
    "base-1": 0b00000011,
    "standard-1": 0b11111111,
    "lenient-1": 0b11000111,
}
PRODUCTION = "standard-1"


def repeated_words(words: list, window: int = WINDOW) -> int:
    """Words covered by windows of ``window`` (a power of two) words that occur at least twice.

    Windows are numbered exactly, by doubling: equal numbers of two adjacent halves make equal
    windows. As soon as all halves differ no longer window can repeat.
    """
    n = len(words)
    if n <= window:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    width, top = 1, len(seen)
    if top == n:
        return 0
    while width < window:
        pairs = ids[:-width] * top + ids[width:]
        width *= 2
        uniques, ids, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        top = len(uniques)
        if top == len(pairs):
            return 0
    starts = np.flatnonzero(counts[ids] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    n_spaces = len(raw) - len(raw.translate(None, SPACES.encode()))
    return (
        len(words),
        len(text) - n_spaces,
        len(raw) - len(raw.translate(None, SYMBOLS.encode())),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - (len(raw) - len(raw.translate(None, _NOT_LETTERS))),
        len(raw.translate(None, _NOT_UPPER)),
        sum(map(eq, words, islice(words, 1, None))),
    )


@F.arrow_udf(_SCHEMA)
def measured(texts: pa.Array) -> pa.Array:
    """measure() over a batch of texts, as a struct column."""
    rows = [measure(t.as_py()) for t in texts]
    columns = zip(*rows, strict=True) if rows else [[] for _ in MEASURES]
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(MEASURES))


def mask_column(rules: tuple[Rule, ...] = RULES) -> Column:
    """The failure bits of all rules as one long."""
    out = F.lit(0).cast("long")
    for r in rules:
        out = out.bitwiseOR(F.when(F.expr(r.fails), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("long"))
    return out


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, every measurement, and ``failed`` (long; bit b set if the rule with bit b failed)."""
    rows = docs.select(F.col("doc_id").cast("long"), measured(F.col("text").cast("string")).alias("m"))
    return rows.select("doc_id", "m.*").withColumn("failed", mask_column(rules))


def verdicts(book: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` under a policy."""
    base = F.col("failed").bitwiseAND(F.lit(POLICIES["base-1"])) != 0
    fails = F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) != 0
    return book.withColumn("base_failed", base).withColumn("kept", ~base & ~fails)


def ablation(book: DataFrame, policy: str = PRODUCTION, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: documents it fails, those it alone fails, and survivors without it.

    The ledger is first reduced to one row per distinct mask (at most 2 ** rules rows), so the cost
    after that does not depend on the corpus.
    """
    mask = POLICIES[policy]
    masks = book.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("m")).agg(F.count(F.lit(1)).alias("n"))
    dims = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in rules if mask >> r.bit & 1))
    each = masks.select("m", "n", F.explode(dims).alias("d")).select("m", "n", "d.*")
    bit = F.col("bit")
    return each.groupBy("rule", "bit").agg(
        F.sum(F.when(F.col("m").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("m") == bit, F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("m").bitwiseAND(F.bitwise_not(bit)) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def apply_policy(docs: DataFrame, policy: str = PRODUCTION) -> DataFrame:
    """The documents a policy keeps, with all their columns, in one pass and without a shuffle."""
    m = fresh("measures", docs.columns)
    bits = POLICIES[policy] | POLICIES["base-1"]
    fails = [F.expr(re.sub(r"\b(" + "|".join(MEASURES) + r")\b", rf"`{m}`.\1", r.fails)) for r in RULES if bits >> r.bit & 1]
    return docs.withColumn(m, measured(F.col("text").cast("string"))).where(~reduce(or_, fails)).drop(m)


#: The ledger and the production verdict in SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents
), m AS (
  SELECT *, regexp_extract_all(t, '[^ \t-\r]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS l FROM d
), win AS (
  SELECT r, i, array_to_string(w[i : i + 7], ' ') AS s FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM m)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM win) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range(8) AS x(k) GROUP BY r
), f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper,
    len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1])) AS n_echoes
  FROM m LEFT JOIN covered c USING (r)
), b AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 6 AND 2 * n_dup_lines > n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END + CASE WHEN 3 * n_letters < word_chars THEN 32 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars THEN 64 ELSE 0 END + CASE WHEN 4 * n_echoes > n_words THEN 128 ELSE 0 END)::BIGINT AS failed FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM b
"""
