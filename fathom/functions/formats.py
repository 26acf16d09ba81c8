"""File formats as column expressions: extension, names, signatures and the structural checks the JVM can do."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.parsers import expat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import dimensions as D


def extension(name: Column) -> Column:
    """Lower-cased last suffix; '' for dotfiles and names without one."""
    return F.lower(F.regexp_extract(name, r"^.+?(\.[^.]+)$", 1))


def native_extension(name: Column) -> Column:
    """As the native analyzer has it: a trailing dot is a suffix."""
    return F.lower(F.regexp_extract(name, r"^.+?(\.[^.]*)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


# These are large, so they are given to Spark as SQL text in one piece; a column is named, not passed.


def _in(column: str, values) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


def format_name(ext: str = "ext") -> Column:
    """Display name; the upper-cased suffix for what has none, Unknown without a suffix."""
    pairs = ", ".join(f"{k!r}, {v!r}" for k, v in D.FORMAT_NAMES.items())
    return F.expr(f"coalesce(try_element_at(map({pairs}), {ext}), CASE WHEN {ext} = '' THEN 'Unknown' ELSE upper(trim(LEADING '.' FROM {ext})) END)")


def has_signature(groups: dict[str, tuple[tuple[int, bytes], ...]], content: str = "content", ext: str = "ext", all_of: tuple[str, ...] = ()) -> Column:
    """Whether any signature of the extension's entry is in its place (all, for ``all_of``); null without an entry."""
    by_marks: dict[tuple, list[str]] = {}
    for e, marks in groups.items():
        by_marks.setdefault((tuple(marks), e in all_of), []).append(e)
    cases = []
    for (marks, every), extensions in by_marks.items():
        tests = [f"substring({content}, {at + 1}, {len(sig)}) = X'{sig.hex()}'" for at, sig in marks]
        cases.append(f"WHEN {_in(ext, extensions)} THEN {(' AND ' if every else ' OR ').join(tests)}")
    return F.expr(f"CASE {' '.join(cases)} END")


def contains_bytes(content: Column, mark: bytes) -> Column:
    return F.contains(content, F.lit(mark))


def jpeg_issues(content: Column) -> Column:
    """array<string> of what a JPEG lacks; bytes after the end marker are no issue."""
    tail = F.when(F.length(content) > 65536, F.substring(content, -65536, 65536)).otherwise(content)
    return _issues([(~F.startswith(content, F.lit(b"\xff\xd8\xff")), "missing JPEG SOI marker"), (~contains_bytes(tail, b"\xff\xd9"), "missing JPEG EOI marker")])


def pdf_issues(content: Column) -> Column:
    tail = F.when(F.length(content) > 2048, F.substring(content, -2048, 2048)).otherwise(content)
    return _issues([(~F.startswith(content, F.lit(b"%PDF-")), "missing PDF header"), (~contains_bytes(tail, b"%%EOF"), "missing PDF EOF marker")])


def _issues(tests: list[tuple[Column, str]]) -> Column:
    return F.array_compact(F.array(*(F.when(bad, F.lit(text)) for bad, text in tests)))


def seven_zip_error(content: Column) -> Column:
    """Null for a sound 7z start header, else what is wrong."""
    stored = F.conv(_little_endian(content, 9, 4), 16, 10).cast("long")
    return (
        F.when(~F.startswith(content, F.lit(bytes.fromhex("377abcaf271c"))), F.lit("7z signature mismatch"))
        .when(F.length(content) < 32, F.lit("truncated 7z start header"))
        .when(stored != F.crc32(F.substring(content, 13, 20)), F.lit("7z start header CRC mismatch"))
    )


def _little_endian(content: Column, at: int, n: int) -> Column:
    return F.concat(*(F.hex(F.substring(content, at + i, 1)) for i in reversed(range(n))))


def family(ext: str = "ext") -> Column:
    """Which validator the full routing gives a file to; first match wins."""
    magic = list(D.SIGNATURES)
    routes = [
        ("png", [".png"]), ("image", D.IMAGE_FAMILY), ("pdf", [".pdf"]), ("zip", D.ARCHIVE_FAMILY), ("iso-bmff", D.ISO_FAMILY), ("tar", [".tar"]), ("7z", [".7z"]), ("media", D.MEDIA_FAMILY),
        ("docx", [".docx"]), ("xlsx", [".xlsx"]), ("pptx", [".pptx"]), ("magic", magic),
    ]
    return _route(ext, routes)


def builtin_family(ext: str = "ext") -> Column:
    """The routing without deep validators."""
    magic = list(D.SIGNATURES)
    return _route(ext, [("zip", [".zip"]), ("docx", [".docx"]), ("xlsx", [".xlsx"]), ("pdf", [".pdf"]), ("image", [".jpg", ".jpeg"]), ("iso-bmff", D.ISO_FAMILY), ("magic", magic)])


def _route(ext: str, routes: list[tuple[str, list[str]]]) -> Column:
    return F.expr(f"CASE {' '.join(f'WHEN {_in(ext, extensions)} THEN {name!r}' for name, extensions in routes)} ELSE 'none' END")


def is_one_of(extensions, ext: str = "ext") -> Column:
    return F.expr(_in(ext, extensions))


# ---- structures that need a walk through the bytes ------------------------------------------------

#: Main part and root element of the office packages.
OFFICE = {"docx": ("word/document.xml", "document"), "xlsx": ("xl/workbook.xml", "workbook"), "pptx": ("ppt/presentation.xml", "presentation")}
_TAR_BLOCK, _TAR_RECORDS = 512, 4096
#: Folders in folders from which a ZIP is odd.
_DEEP = 100


def iso_error(data: bytes, name: str) -> tuple[str | None, list[str], dict[str, str]]:
    """Walks the top-level boxes of the first 4 KiB; a file type box with a known brand must be there."""
    head, at, boxes = data[:4096], 0, []
    while at + 8 <= len(head) and len(boxes) < 24:
        size = int.from_bytes(head[at : at + 4], "big")
        boxes.append((at, head[at + 4 : at + 8]))
        if size == 1 and at + 16 <= len(head):
            size = int.from_bytes(head[at + 8 : at + 16], "big")
        if size < 8:
            break
        at += size
    kinds = [k for _, k in boxes]
    if b"ftyp" not in kinds:
        return f"missing {name} ftyp box", ["no ISO base media ftyp box found in the first boxes"], {}
    i = kinds.index(b"ftyp")
    brand = head[boxes[i][0] + 8 : boxes[i][0] + 12]
    if brand.decode("latin-1") not in D.ISO_BRANDS and not brand.startswith(b"iso"):
        return f"unrecognised {name} brand: {brand!r}", [f"brand {brand!r} is not a known ISO base media brand"], {}
    return None, [], {"brand": brand.decode("latin-1"), "leading_boxes": ",".join(k.decode("latin-1") for k in kinds[:i]), "has_mdat": str(b"mdat" in kinds).lower()}


def octal_number(field: bytes) -> int | None:
    """A numeric header field: octal digits up to the first NUL with blanks around them, zero if there are none; None for anything else."""
    digits = field.partition(b"\0")[0].strip()
    return None if digits.strip(b"01234567") else int(digits or b"0", 8)


def _header_sums(block: np.ndarray) -> tuple[int, int]:
    """The sums of a header block over unsigned and over signed bytes, the checksum field counting as blanks."""
    rest = np.delete(block, np.s_[148:156])
    return int(rest.sum(dtype=np.int64)) + 256, int(rest.view(np.int8).sum(dtype=np.int64)) + 256


def tar_error(data: bytes) -> tuple[str | None, list[str], dict[str, str]]:
    """Whether the headers of an archive add up, each found from the one before; two blocks of zeros end it.

    Up to _TAR_RECORDS blocks are looked at; payloads are skipped.
    """
    whole, rest = divmod(len(data), _TAR_BLOCK)
    if not whole:
        return "not even one TAR block", [f"{len(data)} bytes, a block has {_TAR_BLOCK}"], {}
    blocks = np.frombuffer(data, np.uint8, whole * _TAR_BLOCK).reshape(whole, _TAR_BLOCK)
    at, ends, members = 0, 0, 0
    for number in range(1, _TAR_RECORDS + 1):
        if at >= whole:
            # the file stops where a header should be: nothing of one may be left
            if at == whole and any(data[len(data) - rest :] if rest else b""):
                return "cut-off TAR header", [f"{rest} bytes after the last whole block"], {}
            break
        block = blocks[at]
        if not block.any():
            at, ends = at + 1, ends + 1
            if ends == 2:
                break
            continue
        raw = block.tobytes()
        said = octal_number(raw[148:156])
        if said is None:
            return "TAR checksum is no number", [f"block {number}"], {}
        if said not in (sums := _header_sums(block)):
            return "TAR header does not match its checksum", [f"block {number} says {said}, its bytes {sums[0]}"], {}
        payload = octal_number(raw[124:136]) or 0
        at, members = at + 1 + -(-payload // _TAR_BLOCK), members + 1
    return None, [], {"entries": str(members), "size": str(len(data))}


def _unreadable(archive: zipfile.ZipFile) -> str | None:
    """The first member whose bytes don't match its CRC or can't be unpacked, read piece by piece."""
    for member in archive.infolist():
        try:
            with archive.open(member) as stream:
                while stream.read(1 << 16):
                    pass
        except (zipfile.BadZipFile, zlib.error, EOFError):
            return member.filename
    return None


def _leaves_its_folder(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return (parts[0] == "" and len(parts) > 1) or ".." in parts[:-1]


def _zip_facts(members: list[zipfile.ZipInfo]) -> dict[str, str]:
    deepest = max((m.filename.count("/") for m in members), default=0)
    notes = [f"suspicious path: {m.filename}" for m in members if _leaves_its_folder(m.filename)]
    if deepest > _DEEP:
        notes.append("suspiciously deep directory structure")
    return {
        "file_count": str(len(members)),
        "total_uncompressed_size": str(sum(m.file_size for m in members)),
        "total_compressed_size": str(sum(m.compress_size for m in members)),
        "is_encrypted": "true" if any(m.flag_bits & 1 for m in members) else "false",
        "max_directory_depth": str(deepest),
        "warnings": "; ".join(notes),
    }


def root_element(stream) -> str:
    """Local name of an XML document's root; raises what the parser raises if there is none."""
    found: list[str] = []
    parser = expat.ParserCreate(namespace_separator="}")
    parser.StartElementHandler = lambda name, _: found or found.append(name.rpartition("}")[2])
    while not found:
        piece = stream.read(1 << 12)
        parser.Parse(piece, not piece)
        if not piece:
            break
    return found[0]


def _package_issues(archive: zipfile.ZipFile, kind: str) -> list[str]:
    part, root = OFFICE[kind]
    there = set(archive.namelist())
    issues = [f"missing {p}" for p in ("[Content_Types].xml", part) if p not in there]
    if part in there:
        try:
            with archive.open(part) as stream:
                if (tag := root_element(stream)) != root:
                    issues.append(f"{part} is a {tag}, not a {root}")
        except Exception:  # whatever the parser or the archive raises, the part can't be read
            issues.append(f"{part} is not readable XML")
    return issues


def zip_error(data: bytes, kind: str) -> tuple[str | None, list[str], dict[str, str]]:
    """Member CRCs; for an office package also its parts and the root of the main one."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            if bad := _unreadable(archive):
                return f"damaged member {bad}", [], {}
            issues = _package_issues(archive, kind) if kind in OFFICE else []
            return (f"invalid {kind.upper()} structure" if issues else None), issues, _zip_facts(archive.infolist())
    except zipfile.BadZipFile as e:
        return f"not a ZIP archive: {e}", [], {}
    except Exception as e:  # an encrypted or unknown kind of member, or what else a damaged archive makes of itself
        return f"unreadable archive: {e}", [], {}


def png_error(data: bytes) -> str | None:
    """Walks a PNG's chunks: signature, CRC of each, header first, end last."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return "missing PNG signature"
    at, kinds = 8, []
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        kind, end = data[at + 4 : at + 8], at + 8 + size
        if end + 4 > len(data):
            break
        if zlib.crc32(memoryview(data)[at + 4 : end]) != int.from_bytes(data[end : end + 4], "big"):
            return f"PNG chunk {len(kinds) + 1} does not match its CRC"
        kinds.append(kind)
        at = end + 4
        if kind == b"IEND":
            return None if kinds[0] == b"IHDR" and b"IDAT" in kinds else "PNG without header or image data"
    return "PNG ends before its end chunk"


_WALKED = T.StructType([T.StructField("error", T.StringType()), T.StructField("details", T.ArrayType(T.StringType())), T.StructField("info", T.MapType(T.StringType(), T.StringType()))])
WALKED_FAMILIES = ("zip", "docx", "xlsx", "pptx", "iso-bmff", "tar", "png")


@F.arrow_udf(_WALKED)
def walked_structure(content: pa.Array, kind: pa.Array, name: pa.Array) -> pa.Array:
    """error (null if sound), details and facts for the families that need a walk; null for all others.

    A Python function is evaluated for every row whatever stands around it, so it branches inside.
    """
    out = []
    for c, k, n in zip(content, kind, name, strict=True):
        k = k.as_py()
        if k not in WALKED_FAMILIES or not c.is_valid:
            out.append(None)
            continue
        data = c.as_py()
        if k == "png":
            error, details, info = png_error(data), [], {}
        else:
            error, details, info = iso_error(data, n.as_py()) if k == "iso-bmff" else tar_error(data) if k == "tar" else zip_error(data, k)
        out.append({"error": error, "details": details, "info": list(info.items())})
    return pa.array(out, pa.struct([("error", pa.string()), ("details", pa.list_(pa.string())), ("info", pa.map_(pa.string(), pa.string()))]))


def looks_like_text(text: str, share: float = 0.95) -> bool:
    return bool(text) and sum(c.isprintable() or c.isspace() or c == "﻿" for c in text) / len(text) >= share


def decoded_as(sample: bytes) -> str | None:
    """The encoding that a sample reads as text in, or None."""
    if not sample:
        return None
    try:
        sample.decode("utf-8-sig")
        return "utf-8-sig"
    except UnicodeDecodeError:
        pass
    zeros = [i for i, b in enumerate(sample) if not b]
    for encoding in ("utf-16-le", "utf-16-be", "utf-32-le", "utf-32-be"):
        if encoding.startswith("utf-16"):
            side = encoding.endswith("le")
            if not zeros or sum(i % 2 == side for i in zeros) / len(zeros) < 0.95:
                continue
        try:
            if looks_like_text(sample.decode(encoding)):
                return encoding
        except UnicodeError:
            continue
    return None


@F.arrow_udf(T.StringType())
def text_encoding(sample: pa.Array) -> pa.Array:
    """decoded_as() of a binary column."""
    return pa.array([decoded_as(s.as_py() or b"") for s in sample], pa.string())


# Otherwise the optimizer may copy the calls into each filter and column made from their results.
walked_structure, text_encoding = walked_structure.asNondeterministic(), text_encoding.asNondeterministic()
