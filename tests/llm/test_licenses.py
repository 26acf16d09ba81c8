import re

import pytest

from fathom.llm import licenses

from .odd import documents, empty, rows

PLAIN = [None, "", "CC-BY cc by CC  BY-NC 4.0", "All rights reserved. The General, Public License!", "all rights\nreserved general public licenseé", "cc by cc by"]


def base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), sorted(places), sorted(labels)


@pytest.mark.parametrize("text", PLAIN)
def test_base(text):
    assert licenses.scan(text)[:3] == base(text)


def mit(holder, word="persons"):
    body = licenses.TEXTS["mit"]
    for part in ("[[the mit license]] ", "[[mit license]] ", "[[including the next paragraph]] "):
        body = body.replace(part, "")
    return body.replace("[[copyright {12}]]", f"Copyright (c) 2020 {holder}.").replace("{12}", "the authors").replace("persons", word)


def test_template_accepts_other_holders_and_refuses_other_wording():
    labels = lambda t: [m[0] for m in licenses.scan(t)[3]]
    assert labels("intro text " + mit("Some One Else") + " outro") == ["mit"]
    assert licenses.scan(mit("A"))[4] == 1.0
    assert labels(mit("A", "people")) == []
    assert "apache-2.0" in labels("Licensed under the Apache License, Version 2.0.")
    assert labels("Licensed under the Apache License, Version 3.0.") == []
    assert "cc-by-nc" in labels("Licensed under CC BY-NC 4.0.")


def test_automaton_optional_and_replaceable():
    a = licenses.compile_template("t", "one [[two]] {2} three four")
    yes = ["one three four", "one two three four", "one x y three four", "one two x three four"]
    no = ["one x y z three four", "two three four", "one two three", "one three five"]
    assert all(a.accepts(s.encode().split(), 0) for s in yes)
    assert not any(a.accepts(s.encode().split(), 0) for s in no)


def test_odd_tables(spark):
    got = licenses.find_licenses(documents(spark)).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    assert licenses.find_licenses(empty(spark)).count() == 0


def plain_words(markup):
    """A template's wording with nothing optional and two words for each replaceable part."""
    import re

    out, depth = [], 0
    for part in re.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", markup):
        depth += (part == "[[") - (part == "]]")
        if not depth and part not in ("[[", "]]"):
            out += ["someone", "else"][: int(part[1:-1])] if part[0] == "{" else [part]
    return out


@pytest.mark.parametrize("label", list(licenses.TEXTS))
def test_full_texts_match_and_altered_ones_do_not(label):
    words = plain_words(licenses.TEXTS[label])
    found = lambda w: {m[0] for m in licenses.scan(" ".join(w))[3]}
    assert label in found(["before", *words, "after"])
    fixed = [i for i, w in enumerate(words) if w not in ("someone", "else")]
    for at in (fixed[0], fixed[len(fixed) // 2], fixed[-1]):
        assert label not in found([*words[:at], "altered", *words[at + 1 :]])


def test_hot_texts_take_linear_time():
    n, places, *_ = licenses.scan("cc by " * 40_000)
    assert n == 80_000 and len(places) == 40_000 and places[-1] == 79_998


def test_templates_of_ones_own(spark):
    docs = spark.createDataFrame([(1, "The House License: use it well, Ann Lee."), (2, "the house license use it")], "doc_id long, text string")
    got = {r["doc_id"]: [m["label"] for m in r["matches"]] for r in licenses.find_licenses(docs, {"house": "the house license use it well {2}"}).collect()}
    assert got == {1: ["house"], 2: []}
