"""Text for a voice: what to leave out, and pieces short enough to be spoken at once."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

MOST = 160
PICTOGRAPHS = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{00A9}\x{00AE}\x{203C}\x{2049}\x{2122}\x{2139}\x{2194}-\x{21AA}\x{231A}-\x{23FF}\x{25AA}-\x{25FE}]"


def clean(c: Column) -> Column:
    """Text without pictographs, bullets, quotes and spelled-out links; line ends are sentence ends. Null is empty."""
    for pattern, put in (
        (r"(?i)https?://\S+|www\.\S+", "a link"), (PICTOGRAPHS, " "), (r"[\x{FE0F}\x{200D}\x{20E3}]", ""), ("[•·▪►→←↑↓]", " "), ('["“”]', ""),
        (r"(?U)\s*\n+\s*", ". "), (r"(?U)\s+", " "), (r"(?:\.\s*){2,}", ". "),
    ):
        c = F.regexp_replace(F.coalesce(c, F.lit("")), pattern, put)
    return F.trim(c)


def sentences(c: Column) -> Column:
    """Sentences end at . ! ? or the danda before a space; a point within a word or number ends none."""
    return F.filter(F.split(c, r"(?<=[.!?।])\s+"), lambda s: s != "")


def pieces_of(sentence: str, most: int) -> list[str]:
    """A sentence in pieces: cut after its last comma, semicolon, dash or colon that isn't too early, else at a space, else at the limit."""
    out, rest = [], sentence.strip()
    while len(rest) > most:
        head = rest[:most]
        cut = max(head.rfind(mark) for mark in ",;—:")
        if cut < 0.4 * most:
            cut = head.rfind(" ")
        if cut < 1:
            cut = most - 1
        out.append(rest[: cut + 1].strip())
        rest = rest[cut + 1 :].strip()
    return out + [rest] if re.search(r"[^\W_]", rest) else out


def chunks(df: DataFrame, text_col: str, most: int = MOST) -> DataFrame:
    """df with `chunks`, what to speak one after the other; a limit of 20 or less means the usual one. Where a cut falls depends on the cut before, so this is an Arrow pass."""
    ship(df.sparkSession)
    limit = most if most > 20 else MOST

    @F.pandas_udf("array<string>")
    def cut(each: pd.Series) -> pd.Series:
        return each.map(lambda ss: [p for s in ss for p in pieces_of(s, limit)])

    return df.withColumn("chunks", cut(sentences(clean(F.col(text_col)))))
