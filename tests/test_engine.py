import json
import os
import random

import pytest
from pyspark.sql import functions as F

from fathom import cli
from fathom.config import Config, config_from, load_config_file
from fathom.operators import core, mathscore, modular, native, quarantine, views
from fathom.plans import report
from fathom.plans.engine import Engine
from fathom.sources.corpus import list_files, read_corpus
from fathom.sources.state import Snapshots


@pytest.fixture
def place(tmp_path):
    (tmp_path / "data").mkdir()
    return tmp_path


def engine(spark, place, **kw):
    return Engine(spark, Config(state_dir=str(place / "state"), quarantine_dir=str(place / "data" / "quarantine"), **kw))


def statuses(results):
    return {r["name"]: r["status"] for r in results.collect()}


def test_scan_sequence(spark, place):
    e, d = engine(spark, place), place / "data"
    (d / "same.txt").write_text("ABCDE")
    (d / "edit.txt").write_text("ABCDE")
    (d / "grow.txt").write_text("small")
    (d / "empty.txt").write_text("")
    (d / "cut.txt").write_text("something")
    (d / "fake.png").write_text("text")
    (d / "jump.txt").write_text("readable text " * 500)
    (d / "photo.jpg.locked").write_bytes(random.Random(1).randbytes(8192))
    (d / ".hidden").write_text("h")
    (d / "_under.txt").write_text("u")
    first = statuses(e.scan(d, now=100.0))
    assert first == {
        "same.txt": "NEW_FILE", "edit.txt": "NEW_FILE", "grow.txt": "NEW_FILE", "empty.txt": "SUSPICIOUS_EMPTY", "cut.txt": "NEW_FILE", "fake.png": "CORRUPTED_FORMAT", "jump.txt": "NEW_FILE",
        "photo.jpg.locked": "SUSPECTED_RANSOMWARE", ".hidden": "NEW_FILE", "_under.txt": "NEW_FILE",
    }
    (d / "edit.txt").write_text("12345")
    (d / "grow.txt").write_text("much longer")
    (d / "cut.txt").write_text("")
    (d / "empty.txt").write_text("x")
    (d / "jump.txt").write_bytes(random.Random(2).randbytes(7000))
    second = e.scan(d, now=200.0)
    got = statuses(second)
    assert (got["same.txt"], got["edit.txt"], got["grow.txt"], got["cut.txt"], got["empty.txt"], got["jump.txt"]) == ("VALID", "CORRUPTED_CHECKSUM", "CORRUPTED_SIZE", "CORRUPTED_SIZE", "CORRUPTED_SIZE", "SUSPECTED_RANSOMWARE")
    message = {r["name"]: r["message"] for r in second.collect()}
    assert "entropy jumped" in message["jump.txt"]
    assert statuses(e.scan(d, now=300.0))["edit.txt"] == "CORRUPTED_CHECKSUM"  # damage stays visible
    (d / "edit.txt").write_text("ABCDE")
    e.scan(d, now=400.0)
    row = {os.path.basename(r["file_path"]): r for r in e.baseline.read().collect()}
    assert row["edit.txt"]["last_status"] == "VALID" and row["edit.txt"]["is_corrupted"] == 0 and row["edit.txt"]["first_corrupt"] == 200.0
    assert row["grow.txt"]["size_bytes"] == 5 and row["grow.txt"]["first_seen"] == 100.0 and row["fake.png"]["size_bytes"] == 4

    outcomes = {os.path.basename(r["path"]): r["action"] for r in e.rebaseline([d / "grow.txt", d / "fake.png", d / "gone.txt", place / "state"], now=500.0).collect()}
    assert (outcomes["grow.txt"], outcomes["fake.png"], outcomes["gone.txt"]) == ("rebaselined", "refused", "missing")
    row = {os.path.basename(r["file_path"]): r for r in e.baseline.read().collect()}
    assert row["grow.txt"]["first_corrupt"] is None and row["grow.txt"]["first_seen"] == 100.0 and row["grow.txt"]["last_status"] == "NEW_FILE"
    assert statuses(e.scan(d, now=600.0))["grow.txt"] == "VALID"
    assert statuses(e.analyze_paths([d / "same.txt", d / "nowhere.txt"])) == {"same.txt": "VALID", "nowhere.txt": "MISSING"}


def test_high_entropy_is_quiet_first_and_warned_of_later(spark, place):
    e, d = engine(spark, place), place / "data"
    for name in ("a.txt", "b.bin"):
        (d / name).write_bytes(random.Random(3).randbytes(65536))
    assert not any(r["is_warning"] for r in e.scan(d).collect())
    second = {r["name"]: r for r in e.scan(d).collect()}
    assert second["a.txt"]["status"] == "VALID" and "no format validator" in second["a.txt"]["warnings"][0] and not second["b.bin"]["warnings"]


def test_quarantine_and_restore(spark, place):
    e, d = engine(spark, place), place / "data"
    (d / "x.txt").write_text("x")
    done = {r["path"]: r["ok"] for r in e.quarantine([str(d / "x.txt"), str(d / "none.txt")]).collect()}
    assert list(done.values()) == [True, False] and not (d / "x.txt").exists()
    entry = e.list_quarantine().first()
    assert entry["reason"] == "Automated Quarantine" and entry["quarantine_path"].endswith(".quarantine")
    assert e.scan(d).count() == 0
    (d / "x.txt").write_text("new")
    back = e.restore(entry["quarantine_path"])
    assert "_restored_" in back.name and back.read_text() == "x" and (d / "x.txt").read_text() == "new"
    assert e.list_quarantine().count() == 0 and e.list_quarantine(include_restored=True).first()["restored_at"]
    with pytest.raises(FileNotFoundError):
        e.restore(entry["quarantine_path"])


def test_listing(place):
    d = place / "data"
    (d / "sub").mkdir()
    (d / ".git").mkdir()
    for p in ("b", "A", ".h", "sub/c", ".git/x"):
        (d / p).write_text("1")
    names = lambda **kw: [os.path.relpath(p, d) for p in list_files(d, **kw)]
    assert names() == [".git/x", ".h", "A", "b", "sub/c"]
    assert names(include_hidden=False) == ["A", "b", "sub/c"]
    assert names(recursive=False) == [".h", "A", "b"]
    assert names(exclude=(str(d / "sub"), str(d / "A"))) == [".git/x", ".h", "b"]
    with pytest.raises(FileNotFoundError):
        list_files(d / "none")
    with pytest.raises(NotADirectoryError):
        list_files(d / "A")


NATIVE = {"nul.bin": bytes(512), "rep.bin": b"ABCD" * 64, "ok.zip": b"PK\x03\x04" + os.urandom(60), "bad.zip": b"not a zip", "mix.txt": bytes(range(256)) * 2, "m.mp4": b"\x00\x00\x00\x14ftypisom" + b"\x01" * 8, "e.txt": b"", "a.txt": b"same words", "b.txt": b"same words"}


def test_native_verdict(spark, place):
    for n, c in NATIVE.items():
        (place / "data" / n).write_bytes(c)
    rows = native.duplicate_groups(native.analyze(read_corpus(spark, place / "data")))
    got = {os.path.basename(r["path"]): r for r in rows.collect()}
    assert {n: got[n]["status"] for n in NATIVE} == {
        "nul.bin": "HIGH_NULL_BYTES", "rep.bin": "REPEATING_PATTERN", "ok.zip": "OK", "bad.zip": "MAGIC_MISMATCH", "mix.txt": "SUSPICIOUS_HIGH_ENTROPY_TEXT", "m.mp4": "OK", "e.txt": "EMPTY", "a.txt": "OK", "b.txt": "OK",
    }
    assert got["a.txt"]["duplicate_group_id"] == got["b.txt"]["duplicate_group_id"] == 1 and got["e.txt"]["duplicate_group_id"] == 0
    assert any("duplicate content group #1 (2 files)" in f for f in got["b.txt"]["findings"])
    s = native.summary(rows).first()
    assert (s["total_files"], s["duplicate_files"], s["duplicate_groups"]) == (9, 2, 1)


def test_strategies(spark, place):
    d = place / "data"
    (d / "bad.txt").write_bytes(b"\x00\xff\x80" * 300)
    (d / "zero.bin").write_bytes(bytes(900) + b"x" * 100)
    (d / "hi.txt").write_text("नमस्ते")
    (d / "no.webp").write_bytes(b"RIFFxxxxYYYY")
    (d / "e.txt").write_bytes(b"")
    files = read_corpus(spark, d)
    rows = {n: {os.path.basename(r["path"]): r for r in modular.scan(files, n).collect()} for n in modular.STRATEGIES}
    assert rows["balanced"]["bad.txt"]["is_corrupted"] and not rows["fast"]["bad.txt"]["is_corrupted"]
    assert all(rows[n]["zero.bin"]["is_corrupted"] and not rows[n]["hi.txt"]["is_corrupted"] and not rows[n]["e.txt"]["is_corrupted"] for n in rows)
    assert rows["deep"]["no.webp"]["is_corrupted"] and not rows["fast"]["no.webp"]["is_corrupted"]
    assert "decoded as utf-8-sig" in rows["deep"]["hi.txt"]["details"] and rows["deep"]["e.txt"]["details"][0] == "empty file"
    assert rows["fast"]["zero.bin"]["error"].startswith("null ratio 90.00% >= 85%")
    assert {r["strategy"]: r["corrupted_files"] for r in modular.compare(files).collect()} == {"fast": 1, "balanced": 3, "deep": 3}
    mine = modular.custom([lambda: modular._result(corrupt=F.col("ext") == ".webp", error=F.lit("no webp"))])
    assert modular.scan(files, mine).where("is_corrupted").count() == 1
    with pytest.raises(ValueError, match="unknown"):
        modular.scan(files, "other")
    with pytest.raises(ValueError, match="at least one"):
        modular.custom([])


def test_math_score(spark, place):
    for n, c in {"e.bin": b"", "z.bin": bytes(200), "t.txt": b"some ordinary text, nothing odd about it at all"}.items():
        (place / "data" / n).write_bytes(c)
    got = {os.path.basename(r["path"]): r for r in mathscore.score(read_corpus(spark, place / "data")).collect()}
    assert (got["e.bin"]["math_score"], got["z.bin"]["math_score"], got["t.txt"]["math_score"]) == (1.0, 1.0, 0.0)
    assert got["z.bin"]["is_corrupted"] and not got["t.txt"]["is_corrupted"] and got["t.txt"]["confidence"] == 1.0


def test_read_errors_are_rows(spark):
    rows = spark.createDataFrame([("/x/a.txt", "a.txt", None, None, None, "read failed: denied")], "path string, name string, length long, mtime timestamp, content binary, read_error string")
    base = spark.createDataFrame([], core.BASELINE)
    r = core.analyze(rows, base, 1.0).first()
    assert (r["status"], r["message"], r["has_fault"]) == ("UNREADABLE", "read failed: denied", True)
    assert core.next_baseline(base, core.analyze(rows, base, 1.0), 1.0).count() == 0
    assert native.analyze(rows).first()["status"] == "IO_ERROR"
    assert modular.scan(rows).first()["is_corrupted"] and mathscore.score(rows).first()["confidence"] == 0.0


def test_snapshots_survive_an_older_schema(spark, tmp_path):
    old = Snapshots(spark, tmp_path, "t", "a int")
    old.write(spark.createDataFrame([(1,)], "a int"))
    new = Snapshots(spark, tmp_path, "t", "a int, b string")
    assert new.read().collect() == [(1, None)]
    new.write(new.read())
    new.clear()
    assert new.read().count() == 0


def test_views(spark):
    schema = "path string, status string, is_corrupted boolean, file_type string, message string, checksum string, size_bytes long"
    rows = spark.createDataFrame([("/A/x", "VALID", False, "Text", None, "c1", 5), ("/b/y", "CORRUPTED_SIZE", True, "PDF", "odd", "c2", 50)], schema)
    assert [r["path"] for r in views.search(rows, "pdf").collect()] == ["/b/y"] and views.search(rows, "", corrupted_only=True).count() == 1
    assert [r["path"] for r in views.sorted_by(rows, "size_bytes", descending=True).collect()] == ["/b/y", "/A/x"]
    forced = spark.createDataFrame([("/A/x", "F", True, "", "", "", 0)], schema)
    assert sorted(r["status"] for r in views.overlay(rows, forced).collect()) == ["CORRUPTED_SIZE", "F"]


def test_config(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"database": {"path": "db"}, "scanning": {"skip_hidden_files": True}, "detection": {"entropy_threshold": "x", "entropy_jump_threshold": 3}, "junk": 1}))
    c = config_from(load_config_file(p), state_dir="cli")
    assert (c.state_dir, c.include_hidden, c.entropy_threshold, c.entropy_jump_threshold) == ("cli", False, 7.95, 3.0)
    assert load_config_file(tmp_path / "none") == {} and config_from({}) == Config()


def test_cli(spark, place, capsys):
    d = place / "data"
    (d / "ok.txt").write_text("fine")
    (d / "fake.png").write_text("text")
    state = ["--state-dir", str(place / "state")]
    assert cli.main(["--scan", str(d), "--json", *state], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert out["summary"]["corrupted_files"] == 1 and len(out["results"]) == 2 and len(out["results"][0]) == 13
    assert cli.main(["--scan", str(d), "--fail-on-findings", *state], spark) == 2
    assert "CORRUPTED_FORMAT" in capsys.readouterr().out
    assert cli.main(["--scan", str(place / "nowhere"), *state], spark) == 1
    assert cli.main(["--rebaseline", str(d / "fake.png"), *state], spark) == 1
    assert cli.main(["--rebaseline", str(d), *state], spark) == 3
    assert cli.main(["--modular-scan", str(d), "--compare", "--json"], spark) == 0
    assert cli.main(["--native-scan", str(d), "--fail-on-findings"], spark) == 2
    assert cli.main(["--list-quarantine", *state], spark) == 0
    assert cli.main(["--library-status"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["--scan"])


def test_reports(spark, place):
    (place / "data" / "fake.png").write_text("text")
    results = engine(spark, place).scan(place / "data")
    assert "Corrupted files:      1 (100.00%)" in report.text_report(results)
    assert json.loads(report.export_json(results))["corrupted_type_counts"] == {"PNG": 1}
    assert report.humanise(1536) == "1.50 KB"


def test_quarantine_tables(spark):
    log = spark.createDataFrame([(1, "/a", "/q/a", "r", "2024-01-01", None), (2, "/b", "/q/b", "r", "2024-01-02", "t")], quarantine.LOG)
    new = spark.createDataFrame([("/c", "/q/c", "r", "2024-01-03")], "original_path string, quarantine_path string, reason string, action_date string")
    assert [r["id"] for r in quarantine.listing(quarantine.appended(log, new), include_restored=True).collect()] == [3, 2, 1]
    assert quarantine.find(log, "/q/b").count() == 0 and quarantine.find(log, "/q/a").first()["id"] == 1
