"""Corpora derived by rule from `documents`, so that SQL can derive the same ones.

Extension by doc_id mod 8. Snapshot 0 is the text. Snapshot 1 changes it by the first rule that holds: mod 29
pseudo-random bytes (8 KiB), mod 19 absent, mod 17 empty, mod 13 the first half, mod 11 an edit of equal length;
mod 23 is absent from snapshot 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import from_table

EXTENSIONS = (".txt", ".md", ".csv", ".json", ".log", ".bin", ".locked", "")
#: Times at which the snapshots are scanned.
T0, T1, T2 = 1_700_000_000.0, 1_700_086_400.0, 1_700_172_800.0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _divides(n: int) -> Column:
    return F.col("doc_id") % n == 0


def path_of() -> Column:
    ext = F.array(*map(F.lit, EXTENSIONS))[(F.col("doc_id") % 8).cast("int")]
    return F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), ext)


def random_bytes(seed: Column) -> Column:
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.sha2(F.concat(seed, i.cast("string")).cast("binary"), 256)), ""))


def snapshot(docs: DataFrame, version: int) -> DataFrame:
    """path, name, length, mtime, content, read_error of a snapshot."""
    text = F.encode("text", "UTF-8")
    at = F.timestamp_seconds(F.lit(T0 if not version else T1))
    if not version:
        return from_table(docs.where(~_divides(23)), path_of(), text, at)
    half = F.encode(F.substr("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")), "UTF-8")
    content = (
        F.when(_divides(29), random_bytes(F.col("text")))
        .when(_divides(17), F.lit(b""))
        .when(_divides(13), half)
        .when(_divides(11), F.encode(F.replace("text", F.lit("e"), F.lit("3")), "UTF-8"))
        .otherwise(text)
    )
    return from_table(docs.where(_divides(29) | ~_divides(19)), path_of(), content, at)


#: The same in SQL: tables s0 and s1 (path, content).
SQL = r"""
d AS (
  SELECT doc_id, text, '/corpus/' || source || '/' || lang || '/doc_' || doc_id || ['.txt', '.md', '.csv', '.json', '.log', '.bin', '.locked', ''][doc_id % 8 + 1] AS path FROM documents
), s0 AS (SELECT path, encode(text) AS content FROM d WHERE doc_id % 23 <> 0
), s1 AS (
  SELECT path, CASE WHEN doc_id % 29 = 0 THEN from_hex(list_aggregate(list_transform(range(256), lambda i: sha256(text || i)), 'string_agg', ''))
                    WHEN doc_id % 17 = 0 THEN encode('')
                    WHEN doc_id % 13 = 0 THEN encode(left(text, length(text) // 2))
                    WHEN doc_id % 11 = 0 THEN encode(replace(text, 'e', '3'))
                    ELSE encode(text) END AS content
  FROM d WHERE doc_id % 29 = 0 OR doc_id % 19 <> 0
)"""

#: Headers of the typed corpus: extension, hex before the text. Some are right for their extension, some are not.
TYPED = (
    (".png", "89504e470d0a1a0a"), (".jpg", "ffd8ffe0"), (".gif", "474946383961"), (".webp", "52494646"), (".webp", "000000000000000057454250"), (".pdf", "255044462d312e34"),
    (".mp4", "0000000866726565"), (".gz", "1f8b08"), (".7z", "377abcaf271c"), (".exe", "4d5a"), (".exe", "5a4d"), (".wav", "52494646"), (".heic", "000000186674797068656963"),
    (".sqlite", "53514c69746520666f726d6174203300"), (".bmp", "424d"), (".qqq", ""), (".mp3", "fffb"), (".docx", "504b0304"), (".txt", ""),
)


def typed(docs: DataFrame) -> DataFrame:
    """Files of many extensions: a header by doc_id, then the text; every third .jpg and .pdf has its end marker."""
    i = (F.col("doc_id") % len(TYPED)).cast("int")
    ext, head = F.array(*(F.lit(e) for e, _ in TYPED))[i], F.array(*(F.lit(h) for _, h in TYPED))[i]
    tail = F.when((ext == ".jpg") & _divides(3), F.lit("FFD9")).when((ext == ".pdf") & _divides(3), F.lit("2525454F46")).otherwise("")
    content = F.unhex(F.concat(head, F.hex(F.encode("text", "UTF-8")), tail))
    return from_table(docs, F.concat(F.lit("/typed/f"), F.col("doc_id").cast("string"), ext), content, F.timestamp_seconds(F.lit(T0)))


TYPED_SQL = (
    "k AS (SELECT *, ["
    + ", ".join(f"'{e}'" for e, _ in TYPED)
    + f"][doc_id % {len(TYPED)} + 1] AS ext, ["
    + ", ".join(f"'{h}'" for _, h in TYPED)
    + f"][doc_id % {len(TYPED)} + 1] AS head FROM documents), "
    + "t AS (SELECT doc_id, ext, '/typed/f' || doc_id || ext AS path, upper(head) || hex(encode(text)) || CASE WHEN ext = '.jpg' AND doc_id % 3 = 0 THEN 'FFD9' WHEN ext = '.pdf' AND doc_id % 3 = 0 THEN '2525454F46' ELSE '' END AS hx FROM k)"
)
