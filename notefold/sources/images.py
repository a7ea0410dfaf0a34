"""Image headers (PNG, JPEG, GIF, WebP) read without a decoder."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def header(data: bytes | None) -> tuple[int | None, int | None, str | None]:
    """(width, height, format); nulls for what is no whole header."""
    none = (None, None, None)
    try:
        if not data:
            return none
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return (*struct.unpack(">II", data[16:24]), "png")
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return (*struct.unpack("<HH", data[6:10]), "gif")
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            if data[12:16] == b"VP8X":
                return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), "webp"
            if data[12:16] == b"VP8L":
                bits = int.from_bytes(data[21:25], "little")
                return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "webp"
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF, "webp"
        if data[:2] == b"\xff\xd8":
            i = 2
            while i + 9 < len(data):
                marker, size = data[i + 1], struct.unpack(">H", data[i + 2 : i + 4])[0]
                if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                    h, w = struct.unpack(">HH", data[i + 5 : i + 9])
                    return w, h, "jpeg"
                i += 2 + size
    except (struct.error, IndexError):
        pass
    return none


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("format", T.StringType())]))
def image_header(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([header(c) for c in content], columns=["width", "height", "format"])


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256, width, height, format) of numbered image files below a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[0-9][0-9].*").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), image_header("content").alias("h")).select("name", "size", "sha256", "h.*")
