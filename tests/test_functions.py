import hashlib
import io
import math
import random
import struct
import tarfile
import zipfile
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.functions import bytestats, formats
from fathom.operators import summary, validation
from fathom.sources.corpus import from_table


def plain(data):
    n, c = len(data), Counter(data)
    mean = sum(data) / n if n else 0
    run = best = 0
    last = None
    for b in data:
        run = run + 1 if b == last else 1
        best, last = max(best, run), b
    return {
        "size_bytes": n,
        "entropy": -sum(k / n * math.log2(k / n) for k in c.values()) if n else 0,
        "variance": sum((b - mean) ** 2 for b in data) / n if n > 1 else 0,
        "chi_square": sum((c.get(v, 0) - n / 256) ** 2 / (n / 256) for v in range(256)) if n else 0,
        "max_run": best,
        "unique_bytes": len(c),
        "null_ratio": c[0] / n if n else 0,
        "printable_ratio": sum(k for b, k in c.items() if 32 <= b <= 126 or b in (9, 10, 13)) / n if n else 0,
        "high_ratio": sum(k for b, k in c.items() if b >= 128) / n if n else 0,
        "low_ratio": sum(k for b, k in c.items() if 1 <= b <= 31) / n if n else 0,
    }


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.binary(max_size=600), st.builds(lambda b, n: b * n, st.binary(min_size=1, max_size=40), st.integers(1, 40))))
def test_statistics_equal_the_formulas(data):
    got = bytestats.statistics(data)
    for k, v in plain(data).items():
        assert got[k] == pytest.approx(v, abs=1e-9, rel=1e-9)


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1023, 1024, 65536, 262145])
def test_sizes_at_block_edges(n):
    data = random.Random(n).randbytes(n)
    assert bytestats.statistics(data)["entropy"] == pytest.approx(plain(data)["entropy"], abs=1e-12)


def test_known_entropies():
    assert bytestats.statistics(b"abc")["entropy"] == pytest.approx(1.5849625007211563)
    assert bytestats.statistics(bytes(range(256)))["entropy"] == 8
    assert bytestats.statistics(bytes(100) + b"A" * 100)["null_ratio"] == 0.5


def test_patterns():
    assert bytestats.repeating_pattern(b"ABCD" * 256)[:2] == (4, 256)
    assert bytestats.repeating_pattern(random.Random(1).randbytes(1024)) == (0, 0, 0.0)
    assert bytestats.repeats_blocks(b"x" * 48, 16) and not bytestats.repeats_blocks(b"x" * 47, 16) and bytestats.repeats_blocks(b"x" * 48 + b"y", 16)


def test_digests(spark):
    row = spark.createDataFrame([(b"abc",)], "c binary").select(*(bytestats.checksum(F.col("c"), a).alias(a) for a in ("sha256", "sha512", "md5", "sha1", "blake2b"))).first()
    assert all(row[a] == hashlib.new(a, b"abc").hexdigest() for a in row.asDict())
    with pytest.raises(ValueError, match="unsupported"):
        bytestats.checksum(F.col("c"), "nonsense")


def test_chi_square_of_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 0.0, 2.0])], "o array<double>, e array<double>")
    assert df.select(bytestats.chi_square(F.col("o"), F.col("e")).alias("x")).first()["x"] == pytest.approx(1.0)


@pytest.mark.parametrize(("name", "ext"), [("a.TXT", ".txt"), (".bashrc", ""), ("foo.", ""), ("a.tar.GZ", ".gz"), ("..a", ".a"), ("plain", "")])
def test_extension(spark, name, ext):
    assert spark.createDataFrame([(name,)], "n string").select(formats.extension(F.col("n")).alias("e")).first()["e"] == ext


@pytest.mark.parametrize(("size", "text"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.00 KB"), (1536, "1.50 KB"), (5 << 40, "5.00 TB"), (3 << 60, "3072.00 PB")])
def test_humanised(spark, size, text):
    assert spark.range(1).select(summary.humanised_bytes(F.lit(size)).alias("t")).first()["t"] == text


def make_zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for n, data in members.items():
            z.writestr(n, data)
    return out.getvalue()


def make_png():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    header = struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(b"\0\1\2\3")) + chunk(b"IEND", b"")


def make_tar():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo("a.txt")
        info.size = 700
        t.addfile(info, io.BytesIO(b"z" * 700))
    return out.getvalue()


def flipped(data, at):
    return data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1 :]


def seven(good=True):
    body = struct.pack("<QQI", 32, 32, 7)
    return bytes.fromhex("377abcaf271c") + b"\x00\x04" + struct.pack("<I", zlib.crc32(body) if good else 1) + body + b"\x00" * 64


ROOT = '<w:%s xmlns:w="u"/>'
DOCX = {"[Content_Types].xml": "<a/>", "word/document.xml": ROOT % "document"}
PPTX = {"[Content_Types].xml": "<a/>", "ppt/presentation.xml": ROOT % "presentation"}
BIG_ZIP = make_zip({"a": random.Random(1).randbytes(4000), "b": b"x"})
FTYP = struct.pack(">I", 24) + b"ftypisom" + b"\x00" * 12
CASES = [
    ("ok.zip", BIG_ZIP, True, True), ("bad.zip", flipped(BIG_ZIP, len(BIG_ZIP) * 6 // 10), False, True), ("no.zip", b"not a zip", False, True), ("ok.jar", BIG_ZIP, True, True),
    ("ok.docx", make_zip(DOCX), True, True), ("part.docx", make_zip({"[Content_Types].xml": "<a/>"}), False, True), ("root.docx", make_zip(DOCX | {"word/document.xml": ROOT % "body"}), False, True),
    ("junk.docx", make_zip(DOCX | {"word/document.xml": "nope"}), False, True), ("ok.xlsx", make_zip({"[Content_Types].xml": "<a/>", "xl/workbook.xml": ROOT % "workbook"}), True, True),
    ("ok.pptx", make_zip(PPTX), True, True), ("root.pptx", make_zip(PPTX | {"ppt/presentation.xml": ROOT % "x"}), False, True),
    ("ok.tar", make_tar(), True, True), ("bad.tar", flipped(make_tar(), 300), False, True), ("short.tar", b"x" * 100, False, True),
    ("ok.7z", seven(), True, True), ("bad.7z", seven(False), False, True), ("flip.7z", flipped(seven(), 20), False, True), ("cut.7z", seven()[:20], False, True),
    ("ok.mp4", struct.pack(">I", 8) + b"free" + FTYP + struct.pack(">I", 8) + b"mdat", True, True), ("no.mp4", struct.pack(">I", 8) + b"mdat", False, True), ("odd.mp4", FTYP.replace(b"isom", b"zzzz"), False, True),
    ("ok.jpg", b"\xff\xd8\xff" + b"q" * 70000 + b"\xff\xd9" + bytes(512), True, True), ("cut.jpg", b"\xff\xd8\xffabc", False, True), ("far.jpg", b"\xff\xd8\xff\xff\xd9" + bytes(70000), False, True),
    ("ok.pdf", b"%PDF-1.4\n%%EOF\n", True, True), ("cut.pdf", b"%PDF-1.4\n", False, True), ("fake.png", b"text", False, True), ("ok.png", make_png(), True, True), ("flip.png", flipped(make_png(), 20), False, True), ("bare.png", make_png()[:8], False, True),
    ("riff.wav", b"RIFFxxxx", True, True), ("x.aac", b"zz", True, False), ("a.qqq", b"zz", True, False), ("plain", b"zz", True, False), ("z.txt", b"", True, False),
]


def test_validators(spark):
    rows = spark.createDataFrame([(n, bytearray(c)) for n, c, _, _ in CASES], "p string, c binary")
    files = from_table(rows, F.col("p"), F.col("c")).withColumn("ext", formats.extension(F.col("name")))
    got = {r["path"]: r["validation"] for r in validation.validate(files).collect()}
    assert {n: (got[n]["is_valid"], got[n]["checked"]) for n, *_ in CASES} == {n: (v, c) for n, _, v, c in CASES}
    assert got["ok.mp4"]["info"]["leading_boxes"] == "free"
    light = {r["path"]: r["validation"] for r in validation.validate(files, deep=False).collect()}
    assert not light["ok.tar"]["checked"] and light["root.pptx"]["is_valid"] and light["flip.7z"]["is_valid"] and not light["cut.jpg"]["is_valid"]


@pytest.mark.parametrize(("sample", "encoding"), [
    (b"", None), (b"plain", "utf-8-sig"), ("नमस्ते 你好 Привет 😀".encode(), "utf-8-sig"), ("﻿bom".encode(), "utf-8-sig"), ("hällo wörld, this is text".encode("utf-16-le"), "utf-16-le"),
    ("hällo wörld, this is text".encode("utf-16-be"), "utf-16-be"), (b"\x00\xff\x80" * 300, None),
])
def test_text_decoding(sample, encoding):
    assert formats.decoded_as(sample) == encoding


def tar_with_size(field):
    """make_tar() with another size field in its header and the checksum to match."""
    data = bytearray(make_tar())
    data[124:136] = field.ljust(12, b"\0")[:12]
    data[148:156] = b" " * 8
    data[148:156] = b"%06o\0 " % sum(data[:512])
    return bytes(data)


def test_tar_fields_end_at_their_first_nul():
    size = int(make_tar()[124:135], 8)
    assert formats.tar_error(tar_with_size(b"%o\0zz" % size))[0] is None
    assert formats.octal_number(b"\0\0") == 0 and formats.octal_number(b" 17 \0x") == 15 and formats.octal_number(b"9") is None
    assert formats.tar_error(make_tar()[:512] + b"x" * 100)[0] is None  # the payload is cut off, no header is
    assert formats.tar_error(b"\0" * 512 + b"x" * 100)[0] == "cut-off TAR header"


def test_png_chunks():
    good = make_png()
    assert formats.png_error(good) is None and formats.png_error(good + b"tail") is None
    assert all(formats.png_error(flipped(good, i)) for i in (0, 12, 20, 45, len(good) - 1))
    assert formats.png_error(good[:-12]) and formats.png_error(b"")


def test_batches_of_rows_have_the_statistics_of_each(monkeypatch):
    import random
    import re

    import pyarrow as pa

    rng = random.Random(4)
    rows = [None, b"", b"\0", b"ab" * 30, b"abc" * 2, bytes(range(256)), b"x" * 5000, b"\0" * 10, *(bytes(rng.choices(b"ab\0", k=rng.randint(0, 300))) for _ in range(60)), None]
    whole = bytestats._columns(pa.array(rows, pa.binary())).to_pylist()
    monkeypatch.setattr(bytestats, "_GROUP", 64)
    assert bytestats._columns(pa.array(rows, pa.binary()).slice(2)).to_pylist() == whole[2:]
    for data, got in zip(rows, whole, strict=True):
        if data is None:
            assert got is None
            continue
        counts = [data.count(bytes([b])) for b in range(256)]
        assert got["size_bytes"] == len(data) and got["null_bytes"] == counts[0] and got["unique_bytes"] == sum(c > 0 for c in counts)
        longest = max((len(m.group()) for m in re.finditer(rb"(?s)(.)\1*", data)), default=0)
        assert got["max_run"] == longest
        assert (got["pattern_length"], got["pattern_repeats"]) == bytestats.repeating_pattern(data)[:2]
        tail = data[-4096:]
        assert got["tail_zero_ratio"] == (tail.count(0) / len(tail) if tail else 0)
