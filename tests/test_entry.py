import importlib
import subprocess
import sys

import duckdb

import __spark_entry__ as entry


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_llm_package(tmp_path):
    """The driver deletes that package; the rest must not need it."""
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(os.path.join(root, "fathom"), tmp_path / "fathom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(entry.__file__, tmp_path)
    code = "import __spark_entry__ as e; assert 'scan_summary' in e.queries() and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_streaming_module_imports():
    assert importlib.import_module("fathom.streaming.scan")


def test_math_score_is_its_sql_on_patterns_runs_and_nulls(spark, tmp_path):
    texts = ["", None, "a" * 40, "b" * 200, "abcabcabc" * 50, "\x00" * 100, "x" + "y" * 5000 + "prose that says something", "plain words of a plain text", "\x01\x02é" * 30, "z" * 64]
    docs = spark.createDataFrame([(i, texts[i % len(texts)], "en", "s") for i in range(160)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(entry.oracle_sql()["math_score"]).fetchall()
    got = [tuple(r) for r in entry.queries()["math_score"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) and len(got) > 140
