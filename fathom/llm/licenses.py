"""License scanning by template markup.

A template is wording with two kinds of markup: ``[[ ... ]]`` is optional, ``{n}`` stands for up to n
replaceable words. It is compiled into a token automaton, and a text matches where the automaton accepts
a run of its words: every mandatory word in its place, optional parts present as a whole or absent,
replaceable parts of any wording. One wrong mandatory word and the template doesn't match.

Defined results: a null or empty text has no words and no labels; equal rows get equal results.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Public license wordings, with markup where holders differ. A full text scores 1.0, a notice 0.8.
TEXTS = {
    "mit": "[[the mit license]] [[mit license]] [[copyright {12}]] permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {12} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "isc": "[[isc license]] [[copyright {12}]] permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {6} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {6} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause": "[[copyright {12}]] [[all rights reserved]] redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by {12} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {12} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-3-clause": "[[copyright {12}]] [[all rights reserved]] redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution [[3]] neither the name of {12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by {12} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {12} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "0bsd": "[[copyright {12}]] permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "zlib": "this software is provided as is without any express or implied warranty in no event will {6} be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {1} www apache org licenses license 2 0 [[txt]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-header": "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {1} of the license or at your option any later version {3} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    "lgpl-header": "is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[library]] general public license as published by the free software foundation either version {2} of the license or at your option any later version {3} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details",
    "agpl-header": "is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version {1} of the license or at your option any later version {3} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at {1} mozilla org mpl 2 0",
}
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0 [[the license]]",
    "mit-notice": "[[released]] [[licensed]] under the mit license",
    "gpl-notice": "licensed under the [[terms of the]] [[gnu]] general public license [[as published by the free software foundation]] [[either]] [[version 2]] [[version 3]] [[or]] [[at your option]] [[any later version]]",
    "cc-by-nc": "[[licensed under]] [[creative commons]] cc by nc [[4 0]] [[3 0]] [[2 0]]",
    "cc-by-sa": "[[licensed under]] [[creative commons]] cc by sa [[4 0]] [[3 0]] [[2 0]]",
    "cc-by-nd": "[[licensed under]] [[creative commons]] cc by nd [[4 0]] [[3 0]] [[2 0]]",
    "copyright-notice": "copyright {12} all rights reserved",
}

#: Bytes of words stay (0-9, a-z after lower-casing A-Z, everything beyond ASCII); all others part words.
_TO_WORDS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


@dataclass(frozen=True)
class Automaton:
    """States are numbered; ``step[s]`` has word edges, ``wild[s]`` edges on any word, ``skip[s]`` free edges."""

    label: str
    step: tuple[tuple[bytes, int] | None, ...]
    wild: tuple[int | None, ...]
    skip: tuple[tuple[int, ...], ...]
    anchor: bytes

    @cached_property
    def begins(self) -> set[bytes] | None:
        """The words that a match can begin with; None if any can."""
        first = self.closure({0})
        return None if any(self.wild[s] is not None for s in first) else {e[0] for s in first if (e := self.step[s])}

    def closure(self, states: set[int]) -> set[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return out

    def accepts(self, words: list[bytes], start: int) -> int | None:
        """End of the longest match that begins at ``start``; None if there is none."""
        final, now, best = len(self.step) - 1, self.closure({0}), None
        for at in range(start, len(words) + 1):
            if final in now:
                best = at
            if at == len(words) or not now:
                break
            after = {e[1] for s in now if (e := self.step[s]) and e[0] == words[at]} | {t for s in now if (t := self.wild[s]) is not None}
            now = self.closure(after)
        return best


def compile_template(label: str, markup: str) -> Automaton:
    """A template's automaton. Its anchor, the longest run of plain mandatory words, must be in a text for a match."""
    step: list = [None]
    wild: list = [None]
    skip: list[list[int]] = [[]]
    opened: list[int] = []
    runs, run = [], []
    for part in re.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", markup):
        if part == "[[":
            opened.append(len(step) - 1)
        elif part == "]]":
            skip[opened.pop()].append(len(step) - 1)
        elif part[0] == "{":
            begin, n = len(step) - 1, int(part[1:-1])
            for _ in range(n):
                wild[-1] = len(step)
                step.append(None)
                wild.append(None)
                skip.append([])
            for s in range(begin, begin + n):
                skip[s].append(begin + n)
        else:
            step[-1] = (part.encode(), len(step))
            step.append(None)
            wild.append(None)
            skip.append([])
            if not opened:
                run.append(part)
                continue
        runs.append(run)
        run = []
    runs.append(run)
    anchor = max((" ".join(r) for r in runs), key=len)
    return Automaton(label, tuple(step), tuple(wild), tuple(map(tuple, skip)), f" {anchor} ".encode())


AUTOMATA = tuple((compile_template(k, v), 1.0) for k, v in TEXTS.items()) + tuple((compile_template(k, v), 0.8) for k, v in NOTICES.items())
#: Words that optional or replaceable parts may put before the anchor.
_BEFORE = 40


def _places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a space-padded phrase stands in space-padded words."""
    out, at, words, counted = [], joined.find(phrase), 0, 0
    while at >= 0:
        words, counted = words + joined.count(b" ", counted, at), at
        out.append(words)
        at = joined.find(phrase, at + 1)
    return out


def scan(text: str | None, automata=AUTOMATA) -> tuple[int, list[int], list[str], list[tuple[str, int, int]], float]:
    """Words, places of base phrases, base labels, template matches (label, first word, end), score.

    The score is 1.0 for a full license text, 0.8 for a notice, 0.5 for a base phrase alone, else 0.
    """
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    places, base, matches, score = [], [], [], 0.0
    for phrase, label in PHRASES.items():
        if found := _places(joined, f" {phrase} ".encode()):
            places += found
            base.append(label)
            score = max(score, 0.5)
    for automaton, worth in automata:
        if automaton.anchor not in joined:
            continue
        anchor_words, ahead = automaton.anchor.count(b" ") - 1, _BEFORE + len(automaton.step)
        end = 0
        for at in _places(joined, automaton.anchor):
            if at + anchor_words <= end:
                continue
            for start in range(max(end, at - ahead), at + 1):
                if automaton.begins is not None and words[start] not in automaton.begins:
                    continue
                if (e := automaton.accepts(words, start)) is not None and e > at:
                    matches.append((automaton.label, start, e))
                    end, score = e, max(score, worth)
                    break
    return len(words), sorted(places), sorted(set(base)), matches, score


_MATCH = T.StructType([T.StructField("label", T.StringType()), T.StructField("first_word", T.LongType()), T.StructField("end_word", T.LongType())])
_SCAN = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("places", T.ArrayType(T.LongType())),
    T.StructField("base", T.ArrayType(T.StringType())),
    T.StructField("matches", T.ArrayType(_MATCH)),
    T.StructField("score", T.DoubleType()),
])
_ARROW = pa.struct([
    ("n_words", pa.int64()), ("places", pa.list_(pa.int64())), ("base", pa.list_(pa.string())),
    ("matches", pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))),
    ("score", pa.float64()),
])


def scanner(automata=AUTOMATA):
    """scan() over batches of whole texts."""

    @F.arrow_udf(_SCAN)
    def scanned(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            n, places, base, matches, score = scan(t.as_py(), automata)
            out.append({"n_words": n, "places": places, "base": base, "matches": [{"label": a, "first_word": s, "end_word": e} for a, s, e in matches], "score": score})
        return pa.array(out, _ARROW)

    return scanned


def find_licenses(docs: DataFrame, templates: Mapping[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, places, base, matches (label, first_word, end_word), score of every row; no shuffle.

    ``templates`` adds markup by label, such as whole license bodies; each counts as a full text.
    """
    more = tuple((compile_template(k, v), 1.0) for k, v in (templates or {}).items())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), scanner(AUTOMATA + more)(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*")


def _pattern(markup: str) -> str:
    """A template as a regular expression over words that each have a space after them."""
    out = []
    for part in re.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", markup):
        out.append("(?:" if part == "[[" else ")?" if part == "]]" else f"(?:[^ ]+ ){{0,{part[1:-1]}}}" if part[0] == "{" else f"{part} ")
    return " " + "".join(out)


def oracle() -> str:
    """The query's rows in SQL: places by comparing slices of words, templates as regular expressions."""
    places = " || ".join(f"list_filter(range(1, len(w) - {len(p.split()) - 2}), lambda i: w[i : i + {len(p.split()) - 1}] = {p.split()})" for p in PHRASES)
    base = ", ".join(f"CASE WHEN contains(j, ' {p} ') THEN '{label}' END" for p, label in PHRASES.items())
    found = ", ".join(f"CASE WHEN regexp_matches(j, '{_pattern(m)}') THEN '{label}' END" for label, m in {**TEXTS, **NOTICES}.items())
    join = lambda x: f"coalesce(array_to_string(list_sort(list_distinct(list_filter({x}, lambda v: v IS NOT NULL))), ','), '')"
    full = ", ".join(f"'{label}'" for label in TEXTS)
    return rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), j AS (
  SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS j, {places} AS p FROM d
), f AS (
  SELECT *, [{base}] AS b, list_filter([{found}], lambda v: v IS NOT NULL) AS m FROM j
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(p)::BIGINT AS n_base, (list_min(p) - 1)::BIGINT AS first_word, (list_max(p) - 1)::BIGINT AS last_word, {join('b')} AS base_labels, {join('b || m')} AS labels,
  CASE WHEN len(list_intersect(m, [{full}])) > 0 THEN 1.0 WHEN len(m) > 0 THEN 0.8 WHEN len(p) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM f
"""
