from collections import Counter

import pytest

from fathom.llm import quality

from .odd import documents, empty, rows


def brute(text):
    text = text or ""
    words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.mark.parametrize("text", ["", None, "a b", "x " * 30, "a b c d e f g h i a b c d e f g h", "a b c\x0bd\x0ce", "l\nl\n \nl", "é ü # $ <x>", "a b c d e f g h i j k l m n o p " * 3])
def test_measurements(text):
    assert quality.measure(text)[:5] == brute(text)


def test_ledger_and_verdicts(spark):
    got = quality.verdicts(quality.ledger(documents(spark))).collect()
    assert len(got) == len(rows())
    by = {r[0]: r[1] for r in rows()}
    for r in got:
        if r["doc_id"] is not None:
            n, chars, symbols, lines, repeats = brute(by[r["doc_id"]])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
            assert r["base_failed"] == (n < 20 or 100 * repeats > 30 * n)
            assert not (r["kept"] and r["base_failed"])


def test_policy_keeps_columns_and_agrees_with_the_ledger(spark):
    docs = documents(spark)
    out = quality.apply_policy(docs)
    assert out.schema == docs.schema
    assert out.count() == quality.verdicts(quality.ledger(docs)).where("kept").count()
    assert quality.apply_policy(empty(spark)).count() == 0


def test_ablation_counts(spark):
    book = quality.ledger(documents(spark))
    masks = [r["failed"] for r in book.collect()]
    for r in quality.ablation(book).collect():
        assert r["n_failed"] == sum(bool(m & r["bit"]) for m in masks)
        assert r["n_only"] == sum(m == r["bit"] for m in masks)
        assert r["n_kept_without"] == sum(not m & ~r["bit"] for m in masks)
