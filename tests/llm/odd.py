"""Small tables with nulls, ties, repeated rows, long texts and clashing extra columns."""

import random

WORDS = "ab cd ef gh ij kl mn op qr st uv wx yz the of and to in is it".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp string, slot int, rid long, measures int, `n_words` int"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def rows(seed=1, n=40):
    rng = random.Random(seed)
    out = [(i, "\n".join(prose(rng, rng.randint(3, 40)) for _ in range(rng.randint(1, 5))), "en", f"s{i % 3}") for i in range(n)]
    out += [(100, None, "en", "s0"), (101, "", None, None), (None, out[0][1], "en", "s1"), (102, out[1][1], "en", "s2"), out[2], out[2], (103, " \t\n ", "en", "s0")]
    out += [(104, "### $$$ %%%", "en", "s0"), (105, prose(rng, 20_000), "en", "s1"), (106, out[3][1].replace("ab", "ba", 1), "en", "s1"), (107, "ünï çødé ＡＢ 日本  x \U0001f600", "de", "s2")]
    return [(a, t, l, s, None if t is None else len(t), True, "x", 1, 2, 3, 4) for a, t, l, s in out]


def documents(spark, **kw):
    return spark.createDataFrame(rows(**kw), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
