"""Structural validation of files by format.

Adds ``validation struct<is_valid, checked, format_name, error_message, validator, details, info>``. Only the
formats that need a walk through their bytes reach Python, in one call per row; signatures, JPEG, PDF and 7z
checks stay in the JVM. Optional libraries aren't used here: a format they would read more deeply gets the
structural check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dimensions as D
from ..functions import formats

VALIDATION = "struct<is_valid: boolean, checked: boolean, format_name: string, error_message: string, validator: string, details: array<string>, info: map<string,string>>"
_NO_INFO = "map()"


def _row(is_valid, checked, name, error, validator: str, details=None, info=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.coalesce(is_valid, F.lit(False)).alias("is_valid"),
        F.lit(checked).alias("checked"),
        name.alias("format_name"),
        (none if error is None else error).alias("error_message"),
        F.lit(validator).alias("validator"),
        F.coalesce(details, F.array().cast("array<string>")).alias("details") if details is not None else F.array().cast("array<string>").alias("details"),
        (info if info is not None else F.expr("cast(map() as map<string,string>)")).alias("info"),
    ).cast(VALIDATION)


def _magic(ext: Column, name: Column, validator: str = "magic") -> Column:
    hit = F.coalesce(F.col("_signed"), F.lit(False))
    wrong = F.concat(ext, F.lit(" signature mismatch"))
    details = F.when(~hit, F.array(F.lit("file header does not match expected magic signature")))
    return _row(hit, True, name, F.when(~hit, wrong), validator, details)


def _unchecked(ext: Column, name: Column, reason: str) -> Column:
    info = F.create_map(F.lit("reason"), F.lit(reason), F.lit("extension"), F.when(ext == "", F.lit("<none>")).otherwise(ext))
    return _row(F.lit(True), False, name, None, "none", info=info)


def validate(files: DataFrame, *, deep: bool = True) -> DataFrame:
    """The files with ``validation``; needs columns ext and content (null content gives a null validation).

    ``deep`` chooses the full routing; without it .jar, .apk, .pptx, .7z, images other than JPEG and media get
    their signature only, and .tar and .aac are left unchecked.
    """
    ext, content = F.col("ext"), F.col("content")
    # what several branches need is a column of its own, so that the expressions stay small
    staged = (
        files.withColumn("_kind", (formats.family if deep else formats.builtin_family)())
        .withColumn("_name", formats.format_name())
        .withColumn("_signed", formats.has_signature(D.SIGNATURES))
        .withColumn("_jpeg", F.when(ext.isin(".jpg", ".jpeg"), formats.jpeg_issues(content)))
        .withColumn("_pdf", F.when(ext == ".pdf", formats.pdf_issues(content)))
        .withColumn("_seven", F.when(ext == ".7z", formats.seven_zip_error(content)))
        .withColumn("_walked", formats.walked_structure(F.when(F.col("_kind").isin(list(formats.WALKED_FAMILIES)), content), F.col("_kind"), F.col("_name")))
    )
    name, jpeg, pdf, seven, walked = (F.col(c) for c in ("_name", "_jpeg", "_pdf", "_seven", "_walked"))
    choice = (
        F.when(F.col("_kind").isin(list(formats.WALKED_FAMILIES)), _row(walked["error"].isNull(), True, name, walked["error"], "structure", walked["details"], walked["info"]))
        .when((F.col("_kind") == "image") & ext.isin(".jpg", ".jpeg"), _row(F.size(jpeg) == 0, True, name, F.when(F.size(jpeg) > 0, F.lit("invalid JPEG structure")), "jpeg", jpeg))
        .when(F.col("_kind") == "pdf", _row(F.size(pdf) == 0, True, name, F.when(F.size(pdf) > 0, F.lit("invalid PDF structure")), "pdf", pdf))
        .when(F.col("_kind") == "7z", _row(seven.isNull(), True, name, seven, "7z"))
        .when(F.col("_kind") == "media", F.when(F.col("_signed").isNotNull(), _magic(ext, name, "magic (ffprobe unavailable)")).otherwise(_unchecked(ext, name, "ffprobe not available and no container signature for this type")))
        .when(F.col("_kind").isin("magic", "image"), _magic(ext, name))
        .otherwise(_unchecked(ext, name, "no specific validator available" if deep else "no structural validator for this type"))
    )
    return staged.withColumn("validation", F.when(content.isNotNull(), choice)).drop("_kind", "_name", "_signed", "_jpeg", "_pdf", "_seven", "_walked")


def library_status() -> dict[str, bool]:
    """Which optional libraries the driver has."""
    from importlib.util import find_spec
    from shutil import which

    found = {n: find_spec(m) is not None for n, m in (("pillow", "PIL"), ("pypdf", "pypdf"), ("python-docx", "docx"), ("openpyxl", "openpyxl"), ("python-pptx", "pptx"), ("numpy", "numpy"))}
    return found | {"ffprobe": which("ffprobe") is not None}
