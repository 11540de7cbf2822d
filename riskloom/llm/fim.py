"""Fill-in-middle: texts cut into prefix, middle and suffix, and put together again in another order.

A text becomes a numpy array of its code points (UTF-32). Each code point has a class: with unit `char` neighbours always differ,
with `word` blanks (space and \\x09-\\x0D) and other signs are two classes, with `line` each line is one, its end included. Where
the classes of neighbours differ, a unit ends (flatnonzero). Of the n + 1 bounds of n units two are chosen by hashes of the
seed and the row's key; the pieces are sliced and encoded again.

Null text counts as empty. A text that is empty, holds a sentinel or is not chosen stays as it is (form `plain`). A null key
hashes as an empty one; rows with equal keys and texts get equal results, in any partitioning. Columns that have a new column's
name are replaced, others stay. Empty tables give empty tables; texts of any length are handled one at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, quoted, with_arrow

#: What stands before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
BLANK = [32, 9, 10, 11, 12, 13]


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def text_of(codes: np.ndarray) -> str:
    return codes.tobytes().decode("utf-32-le")


def bounds(codes: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin and end: one place more than there are units."""
    if unit == "char":
        classes = np.arange(len(codes)) & 1
    elif unit == "word":
        classes = np.isin(codes, BLANK)
    elif unit == "line":
        ends = np.cumsum(codes == 10)
        classes = ends - (codes == 10)
    else:
        raise ValueError(f"no such unit: {unit}")
    inner = np.flatnonzero(classes[1:] != classes[:-1]) + 1
    return np.concatenate([[0], inner, [len(codes)]]) if len(codes) else np.zeros(1, np.int64)


def rearranged(text: str, h: np.ndarray, rate: int, spm: int, unit: str, sentinels: tuple[str, str, str]) -> tuple[str, str, int | None, int | None]:
    """Output, form, and the lengths of prefix and middle, by four hashes."""
    if not text or any(s in text for s in sentinels) or h[2] % 100 >= rate:
        return text, "plain", None, None
    codes = points(text)
    places = bounds(codes, unit)
    low, high = sorted(int(places[x % len(places)]) for x in h[:2])
    prefix, middle, suffix = (text_of(c) for c in (codes[:low], codes[low:high], codes[high:]))
    p, s, m = sentinels
    if h[3] % 100 < spm:
        return f"{s}{suffix}{p}{prefix}{m}{middle}", "spm", low, high - low
    return f"{p}{prefix}{s}{suffix}{m}{middle}", "psm", low, high - low


def rebuilt(output: str, form: str, sentinels: tuple[str, str, str]) -> str:
    """The text that an output of a form was made of."""
    p, s, m = sentinels
    if form == "plain":
        return output
    first, second = (p, s) if form == "psm" else (s, p)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(m)
    return one + middle + two if form == "psm" else two + middle + one


def seeds(key: Column, seed: int) -> Column:
    """A hash of seed and key as hexadecimal digits, of which four groups of eight are used."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 32)


FIELDS = [T.StructField("fim", T.StringType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType())]


def fim_transform(
    docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", seed: int = 1, rate: int = 90, spm: int = 20, unit: str = "char",
    sentinels: tuple[str, str, str] = SENTINELS, keep: list[str] | None = None,
) -> DataFrame:
    """docs with fim (the text rearranged), form (plain, psm: prefix first, spm: suffix first), prefix_chars and middle_chars.

    rate: percentage of texts that are rearranged; spm: percentage of these in the form spm. Lengths are in code points. No
    sentinel may hold another one's first sign but at its start, or outputs would not be told apart.
    """
    if any(not s or s[0] in t[1:] for s in sentinels for t in sentinels) or len(set(sentinels)) < 3:
        raise ValueError("sentinels must differ, and none may hold another's first sign inside")
    prepare(docs.sparkSession)
    kept = list(docs.columns if keep is None else keep)
    d = docs.withColumn("__seeds", seeds(quoted(key_col), seed))

    def run(texts, hashes):
        made = [rearranged(t.as_py() or "", np.frombuffer(bytes.fromhex(h.as_py()), ">u4").astype(np.int64), rate, spm, unit, sentinels) for t, h in zip(texts, hashes)]
        columns = list(zip(*made)) or [()] * 4
        return [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))]

    return with_arrow(d, [text_col, "__seeds"], FIELDS, run, kept)


def fim_restore(df: DataFrame, fim_col: str = "fim", form_col: str = "form", out_col: str = "restored", sentinels: tuple[str, str, str] = SENTINELS, keep: list[str] | None = None) -> DataFrame:
    """df with the exact text that each output of fim_transform was made of; a null output or form gives an empty text."""
    prepare(df.sparkSession)

    def run(outputs, forms):
        return [pa.array([rebuilt(o.as_py() or "", f.as_py() or "plain", sentinels) for o, f in zip(outputs, forms)], pa.string())]

    return with_arrow(df, [fim_col, form_col], [T.StructField(out_col, T.StringType())], run, keep)
