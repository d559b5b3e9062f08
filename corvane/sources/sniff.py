"""What a file is, from its first bytes and its name."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as PT

from corvane.functions import text as T

OFFICE = ("docx", "pptx", "xlsx")
TEXTUAL = ("md", "markdown", "txt", "html", "htm", "csv")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*[/\\]", ""), r"\.[^.]*$", "")


def file_format(path: Column, head: Column) -> Column:
    """pdf, png, jpeg, gif, bmp, webp, office, text or unknown. Office files need the suffix and the archive's mark."""
    sign = F.hex(F.substring(head, 1, 16))
    ext = extension(path)
    return (
        F.when(sign.startswith("255044462D"), "pdf")
        .when(sign.startswith("89504E470D0A1A0A"), "png")
        .when(sign.startswith("FFD8FF"), "jpeg")
        .when(sign.startswith("474946383761") | sign.startswith("474946383961"), "gif")
        .when(sign.startswith("424D"), "bmp")
        .when(sign.startswith("52494646") & (F.substring(sign, 17, 8) == "57454250"), "webp")
        .when(sign.startswith("504B0304") & ext.isin(*OFFICE), "office")
        .when(ext.isin(*TEXTUAL), "text")
        .otherwise("unknown")
    )


def source_type(fmt: Column) -> Column:
    return F.when(fmt == "pdf", "pdf").when(fmt.isin("png", "jpeg", "gif", "bmp", "webp"), "image").when(fmt.isin("office", "text"), "document").otherwise("unknown")


@F.pandas_udf(PT.StructType([PT.StructField("width", PT.IntegerType()), PT.StructField("height", PT.IntegerType())]))
def image_size(heads: pd.Series) -> pd.DataFrame:
    """Width and height of PNG, GIF, BMP, WEBP and JPEG images from their first bytes; null for other files."""
    sizes = [_size(bytes(h)) if h is not None else (None, None) for h in heads]
    return pd.DataFrame(sizes, columns=["width", "height"]).astype("Int32")


def _size(b: bytes) -> tuple[int | None, int | None]:
    little, big = (lambda i, n: int.from_bytes(b[i : i + n], "little")), (lambda i, n: int.from_bytes(b[i : i + n], "big"))
    if b.startswith(b"\x89PNG\r\n\x1a\n") and len(b) >= 24:
        return big(16, 4), big(20, 4)
    if b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
        return little(6, 2), little(8, 2)
    if b.startswith(b"BM") and len(b) >= 26:
        return little(18, 4), abs(int.from_bytes(b[22:26], "little", signed=True))
    if b.startswith(b"RIFF") and b[8:12] == b"WEBP" and len(b) >= 30:
        if b[12:16] == b"VP8X":
            return little(24, 3) + 1, little(27, 3) + 1
        if b[12:16] == b"VP8L":
            bits = little(21, 4)
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        if b[12:16] == b"VP8 ":
            return little(26, 2) & 0x3FFF, little(28, 2) & 0x3FFF
    if b.startswith(b"\xff\xd8"):
        at = 2
        # Segments follow one another; the frame header has the size.
        while at + 9 <= len(b) and b[at] == 0xFF:
            kind = b[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                return big(at + 7, 2), big(at + 5, 2)
            at += 2 + big(at + 2, 2)
    return None, None


@F.pandas_udf(PT.StructType([PT.StructField("is_archive", PT.BooleanType()), PT.StructField("pages", PT.IntegerType())]))
def container(contents: pd.Series) -> pd.DataFrame:
    """Whether a file is a whole archive (Office files are), and the number of pages that a PDF states; null where it has none."""
    import io
    import re
    import zipfile

    rows = [(zipfile.is_zipfile(io.BytesIO(bytes(c))), len(re.findall(rb"/Type\s*/Page(?![A-Za-z])", bytes(c))) or None if bytes(c[:5]) == b"%PDF-" else None) if c is not None else (False, None) for c in contents]
    return pd.DataFrame(rows, columns=["is_archive", "pages"]).astype({"pages": "Int32"})


def rejected(size: Column, width: Column, height: Column, most_bytes: int, most_pixels: int) -> Column:
    """Why a file is refused, or null."""
    return F.when(size > most_bytes, "too many bytes").when(width.cast("long") * height.cast("long") > most_pixels, "too many pixels")


def sniff(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file below ``path``. The content goes to its hash, its first 64 KB and, for archives and PDFs, their
    structure. Empty files give no row; an Office file that is no archive is unknown."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = files.select("path", F.col("length").alias("file_size"), F.substring("content", 1, 65_536).alias("head"), F.sha2("content", 256).alias("sha256"), container(F.when(F.hex(F.substring("content", 1, 4)).isin("504B0304", "25504446"), F.col("content"))).alias("c"))
    found = file_format(F.col("path"), F.col("head"))
    rows = rows.withColumn("format", F.when((found == "office") & ~F.col("c.is_archive"), "unknown").otherwise(found)).withColumn("size", image_size("head"))
    return rows.select("path", "file_size", "sha256", "format", source_type(F.col("format")).alias("source_type"), "size.width", "size.height", "c.pages", T.default_title(stem(F.col("path"))).alias("title"))
