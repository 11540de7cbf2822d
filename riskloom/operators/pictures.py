"""Pictures before reading: size from the file's first bytes, the size to hand on, and a code's finder runs."""

from __future__ import annotations

import struct
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Limits of a picture. (Fixed values.)
MOST_PIXELS, MOST_SIDE, REFUSED_PIXELS = 2_800_000, 2600, 150_000_000
#: Bytes of a file that hold its size.
HEAD = 65_536


def plan(width: Column, height: Column) -> Column:
    """A struct of refused, scale, width, height, shrunk; null for a size that is not positive."""
    w, h = width.cast("double"), height.cast("double")
    area = F.nullif(w * h, F.lit(0.0))
    scale = F.least(F.lit(1.0), MOST_SIDE / F.nullif(F.greatest(w, h), F.lit(0.0)), F.sqrt(MOST_PIXELS / area))
    refused = area > REFUSED_PIXELS
    side = lambda x: F.when(refused, x).otherwise(F.greatest(F.lit(1.0), F.floor(x * scale + 0.5))).cast("long")
    return F.when((w > 0) & (h > 0), F.struct(
        refused.alias("refused"), F.when(refused, 0.0).otherwise(scale).alias("scale"), side(w).alias("width"), side(h).alias("height"), (~refused & (scale < 1)).alias("shrunk"),
    ))


def finder_module(runs: list[Column], strict: bool = False) -> Column:
    """The module's size if five runs are near 1:1:3:1:1, else 0."""
    total = reduce(lambda a, b: a + b, runs)
    m = total / 7
    thin, middle = (0.5, 0.8) if strict else (0.55, 1.25)
    near = [F.abs(r - m * (3 if i == 2 else 1)) < m * (middle if i == 2 else thin) for i, r in enumerate(runs)]
    return F.when((total >= 7) & reduce(lambda a, b: a & b, near), m).otherwise(0.0)


def size_of(head: bytes | None) -> tuple[int, int] | None:
    """Width and height that a PNG, GIF, JPEG or WebP file's first bytes tell."""
    if head is None or len(head) < 12:
        return None
    size = None
    if head.startswith(b"\x89PNG") and len(head) >= 24:
        size = struct.unpack_from(">II", head, 16)
    elif head.startswith(b"GIF"):
        size = struct.unpack_from("<HH", head, 6)
    elif head.startswith(b"\xff\xd8"):
        size = _jpeg(head)
    elif head.startswith(b"RIFF") and head[8:12] == b"WEBP":
        size = _webp(head)
    return size if size and min(size) > 0 else None


def _jpeg(head: bytes) -> tuple[int, int] | None:
    """Segments are skipped by their lengths up to the frame's own."""
    at = 2
    while at + 9 < len(head):
        mark = head[at + 1]
        if head[at] != 0xFF or mark == 0xFF:
            at += 1
        elif mark in (0x01, 0xD8) or 0xD0 <= mark <= 0xD7:
            at += 2
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", head, at + 5)
            return w, h
        else:
            (length,) = struct.unpack_from(">H", head, at + 2)
            if length < 2:
                return None
            at += 2 + length
    return None


def _webp(head: bytes) -> tuple[int, int] | None:
    kind, n = head[12:16], len(head)
    if kind == b"VP8X" and n >= 30:
        return int.from_bytes(head[24:27], "little") + 1, int.from_bytes(head[27:30], "little") + 1
    if kind == b"VP8 " and n >= 30:
        w, h = struct.unpack_from("<HH", head, 26)
        return w & 0x3FFF, h & 0x3FFF
    if kind == b"VP8L" and n >= 25 and head[20] == 0x2F:
        bits = int.from_bytes(head[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
    return None


def with_size(df: DataFrame, content: str) -> DataFrame:
    """df with `width` and `height` (null where unknown); only each file's first bytes reach Python."""
    ship(df.sparkSession)

    @F.pandas_udf("width long, height long")
    def sizes(heads: pd.Series) -> pd.DataFrame:
        found = [size_of(None if h is None else bytes(h)) or (None, None) for h in heads]
        return pd.DataFrame({"width": pd.array([w for w, _ in found], "Int64"), "height": pd.array([h for _, h in found], "Int64")})

    return df.withColumn("_size", sizes(F.substring(F.col(content), 1, HEAD))).select("*", "_size.width", "_size.height").drop("_size")
