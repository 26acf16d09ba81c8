from collections import Counter

import pytest

from fathom.llm import mixing

from .odd import documents, empty, rows


@pytest.mark.parametrize("slots", [{"a": 1}, {"a": 1, "b": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 333, "b": 333, "c": 334}, {f"s{i}": 1 + i * i for i in range(12)}])
def test_deviation_stays_below_one_block(slots):
    d = sum(slots.values())
    places = mixing.one_period(slots)
    assert sorted(p for x in places.values() for p in x) == list(range(d))
    done = Counter()
    owner = {p: s for s, x in places.items() for p in x}
    for slot in range(d):
        done[owner[slot]] += 1
        assert all(abs(done[s] - w * (slot + 1) / d) < 1 for s, w in slots.items())


def test_plan_places_every_block_once():
    blocks = {"a": 1000, "b": 37, "c": 5, "d": 1}
    spots = set()
    for s, stretches in mixing.plan(blocks, mixing.whole_slots({"a": 1, "b": 2, "c": 2, "d": 5}, 20)).items():
        for b in range(blocks[s]):
            x = next(x for x in stretches if x["first"] <= b < x["last"])
            k = b - x["first"]
            spots.add(x["base"] + k // x["w"] * x["period"] + x["places"][k % x["w"]])
    assert spots == set(range(sum(blocks.values())))


def test_whole_slots_add_up():
    got = mixing.whole_slots({"a": 0.7, "b": 0.299, "c": 0.001, "none": 0}, 100)
    assert sum(got.values()) == 100 and got["c"] >= 1 and "none" not in got


def test_schedule(spark):
    docs = documents(spark)
    got = mixing.schedule(docs, block_chars=500, slots=30).collect()
    assert len(got) == len(rows())
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    by_source = {}
    for r in got:
        by_source.setdefault(r["source"], []).append((r["start"], r["n_chars"], r["block"]))
    for spans in by_source.values():
        total = 0
        for start, n, block in sorted(spans):
            assert block == start // 500 and start <= total
            total = max(total, start + n)
        assert total == sum(n for _, n, _ in spans)
    slots = {(r["source"], r["block"]): r["slot"] for r in got}
    assert len(set(slots.values())) == len(slots)


def test_mixed_keeps_rows_and_columns(spark):
    docs = documents(spark)
    out = mixing.mixed(docs, {"s0": 3.0, "s1": 1.0}, block_chars=500)
    assert out.columns == docs.columns
    assert sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
    assert mixing.mixed(empty(spark)).count() == 0


def test_tasks_lay_out_what_is_too_much_for_the_driver(spark):
    docs = documents(spark)
    rows_of = lambda **kw: sorted(map(repr, mixing.schedule(docs, block_chars=300, slots=30, **kw).collect()))
    assert rows_of(max_slots=0) == rows_of()


def test_many_sources(spark):
    """More sources than the driver lays out: 1,500, with one block each or a few."""
    docs = spark.createDataFrame([(i, "x" * (40 * (1 + i % 3)), f"s{i:04d}") for i in range(1500)], "doc_id long, text string, source string")
    got = mixing.schedule(docs, block_chars=40).collect()
    assert len(got) == 1500 and all(r["release"] <= r["slot"] < r["deadline"] for r in got)
    assert len({r["slot"] for r in got}) == 1500
