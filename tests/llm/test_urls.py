from datetime import datetime

from fathom.llm import urls


def at(day):
    return datetime(2024, 1, day)


ENTRIES = [
    ("l", "block", "domain", "bad.com", at(5), True),
    ("l", "block", "domain", "bad.com", at(10), False),
    ("l", "block", "domain", "bad.com", at(10), False),
    ("l", "allow", "host", "good.bad.com", at(1), True),
    ("l", "block", "prefix", "x.org/a", at(3), True),
    ("l", "block", "url", "y.org/p?q=1", at(3), True),
    ("l", "block", "host", "z.org", at(4), False),
    (None, None, "host", None, None, True),
]
CASES = [
    (1, "http://www.bad.com/x", at(4), True),
    (2, "http://www.bad.com/x", at(5), False),
    (3, "https://user@WWW.BAD.com:80/x#f", at(9), False),
    (4, "http://bad.com", at(10), True),
    (5, "http://good.bad.com/1", at(6), True),
    (6, "http://x.org/a/b?c", at(3), False),
    (7, "http://x.org/ab", at(3), True),
    (8, "http://y.org/p?q=1", at(3), False),
    (9, "http://y.org/p?q=2", at(3), True),
    (10, "http://z.org/", at(9), True),
    (11, None, at(9), True),
    (12, "http://bad.com", None, True),
    (13, "", at(9), True),
    (2, "http://www.bad.com/x", at(5), False),
]


def tables(spark, cases, entries=ENTRIES):
    captures = spark.createDataFrame([(i, u, t, "x", 7, False) for i, u, t, _ in cases], "id long, url string, fetched_at timestamp, pattern string, n_active int, kept boolean")
    return captures, spark.createDataFrame(entries, urls.ENTRY_COLUMNS)


def test_entries_active_at_fetch_time_decide(spark):
    got = urls.filter_captures(*tables(spark, CASES)).collect()
    assert sorted((r["id"], r["kept"]) for r in got) == sorted((i, k) for i, _, _, k in CASES)
    assert {r["id"]: r["kind"] for r in got}[5] == "host"


def test_empty_tables(spark):
    assert urls.filter_captures(*tables(spark, [])).count() == 0
    assert urls.filter_captures(*tables(spark, CASES, [])).where("kept").count() == len(CASES)


def test_plan_has_no_python(spark):
    captures, entries = tables(spark, CASES)
    plan = urls.filter_captures(captures, entries)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan
