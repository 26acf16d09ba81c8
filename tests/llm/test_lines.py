import random
import string

import numpy as np
import pytest

from fathom.llm import lines

from .odd import documents, empty
from .test_components import brute as union


def plain_distance(a, b):
    """Edit distance by the textbook table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def alike(a, b):
    n = max(len(a), len(b))
    return 10 * plain_distance(a, b) <= 2 * n


def normalised(text):
    for k, line in enumerate((text or "").split("\n")):
        if n := " ".join("".join(c for c in line.lower() if c not in string.punctuation).split()):
            yield k, n


def plain(docs):
    """(doc_id, text) -> dropped lines, by edit similarity of all pairs of distinct normalised lines."""
    first = {}
    for i, text in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0)):
        for k, n in normalised(text):
            first.setdefault(n, (-1 if i is None else i, k))
    keys = list(first)
    root = union([(a, b) for a in range(len(keys)) for b in range(a) if alike(keys[a], keys[b])])
    best = {}
    for a, n in enumerate(keys):
        r = root.get(a, a)
        best[r] = min(best.get(r, first[n]), first[n])
    kept = {n: best[root.get(a, a)] for a, n in enumerate(keys)}
    return {(i, text): [k for k, n in normalised(text) if kept[n] != (-1 if i is None else i, k)] for i, text in set(docs)}


LONG = " ".join(f"word{i}" for i in range(80))
TEXTS = [
    (1, "The first line here.\nsecond row of it\n---\n"),
    (2, "the FIRST line, here\nanother one"),
    (3, "\n".join(f"{LONG} tail{j}" for j in range(4))),
    (4, f"{LONG} tail9\nown line of four"),
    (5, None),
    (6, ""),
    (7, "x\nx\ny"),
    (7, "x\nx\ny"),
    (8, "some words that nobody else has written down so far"),
    (9, "some words that nobody else has ever written down so far"),
]


def got_lines(spark, docs):
    marked, lost = lines.with_dropped(spark.createDataFrame(docs, "doc_id long, text string").repartition(2))
    return {(r["doc_id"], r["text"]): r[lost] or [] for r in marked.collect()}


def test_dropped_lines(spark):
    assert got_lines(spark, TEXTS) == plain(TEXTS)


def test_tiles_cover_what_stars_leave(spark, monkeypatch):
    """Lines that share a key but not all of which are like the smallest."""
    rng = random.Random(3)
    common = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = [(i, f"{common} " + " ".join("".join(rng.choices("abcdefgh", k=9)) for _ in range(3 + i % 4))) for i in range(24)]
    docs += [(100 + i, t + "x") for i, t in docs[:40]]
    monkeypatch.setattr(lines, "TILE", 4)
    assert got_lines(spark, docs) == plain(docs)


def prose(rng, n):
    return ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(n)]


def changed(rng, words, times):
    out = list(words)
    for _ in range(times):
        at, how = rng.randrange(len(out)), rng.randrange(4)
        word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
        if how == 0:
            out[at] = word
        elif how == 1:
            out[at] = out[at][:-1] + "q" + out[at][-1]
        elif how == 2:
            out.insert(at, word)
        else:
            del out[at]
    return out


def met(a, b):
    offsets, keys = lines.line_keys([" ".join(a).encode(), " ".join(b).encode()])
    return bool(set(keys[: offsets[1]].tolist()) & set(keys[offsets[1] :].tolist()))


@pytest.mark.parametrize(("n", "times"), [(8, 1), (10, 1), (12, 1), (16, 1), (20, 1), (30, 2), (40, 2), (60, 4), (80, 4), (160, 8), (320, 16)])
def test_recall_of_changed_lines(n, times):
    """At least nine in ten pairs of lines of an edit similarity of 0.8 meet on a key, at every length from 8 words."""
    rng, seen, found = random.Random(n), 0, 0
    while seen < 120:
        a = prose(rng, n)
        b = changed(rng, a, times)
        if n <= 16 and not alike(" ".join(a), " ".join(b)):
            continue
        seen += 1
        found += met(a, b)
    assert found >= 0.9 * seen


def test_recall_of_the_operator(spark):
    """One change to a line, against edit similarity by the textbook table."""
    rng, docs, pairs = random.Random(7), [], 0
    for i in range(100):
        a = prose(rng, rng.choice([8, 9, 12, 15, 20, 25]))
        b = changed(rng, a, 1)
        pairs += alike(" ".join(a), " ".join(b))
        docs += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    got = got_lines(spark, docs)
    found = sum(bool(v) for v in got.values())
    assert pairs > 85 and 0.9 * pairs <= found <= pairs


def test_keys_of_unlike_lines_differ():
    rng = random.Random(1)
    some = [prose(rng, rng.randint(3, 60)) for _ in range(3000)]
    offsets, keys = lines.line_keys([" ".join(x).encode() for x in some])
    assert len(np.unique(keys)) == len(keys) == offsets[-1]


def test_deduplicated_keeps_columns(spark):
    docs = documents(spark)
    out = lines.deduplicated(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r["n_chars"] == len(r["text"]) for r in got if r["text"] is not None)
    assert {100, 101, 103, 104} <= {r["doc_id"] for r in got}
    assert lines.deduplicated(empty(spark)).count() == 0


def test_deduplicated_texts(spark):
    docs = [(1, "a b\n\nc d\n"), (2, "e f\nA B.\n\ng h\nc d\ni j\n"), (3, "c d\na b"), (4, "\n"), (5, None)]
    got = {r["doc_id"]: r["text"] for r in lines.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: "a b\n\nc d\n", 2: "e f\n\ng h\ni j\n", 4: "\n", 5: None}


@pytest.mark.parametrize(("a", "b", "n"), [("", "", 0), ("abc", "", 3), ("kitten", "sitting", 3), ("flaw", "lawn", 2), ("äb" * 50, "äb" * 49, 2)])
def test_levenshtein(a, b, n):
    assert lines.levenshtein(a, b) == n


def test_similar_is_edit_similarity():
    rng = random.Random(5)
    for _ in range(400):
        a = "".join(rng.choices("abc ", k=rng.randint(1, 40)))
        b = "".join(c if rng.random() > 0.15 else rng.choice("abc ") for c in a)[rng.randint(0, 2) :] or "a"
        assert lines.similar(a, b) == alike(a, b)
