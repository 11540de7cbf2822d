"""Secret scans: fixed patterns, and a token-efficiency test.

Random strings are spelled in more tokens than words are. Each run of letters, digits and `+/_=-`, less what the fixed patterns
have found in it, of which a stretch of CANDIDATE or more characters is left, is encoded under a tiktoken vocabulary; few
characters a token (RATIO or fewer) expose it, unless it is a digest of a known length, a UUID, a number, a rule of one
repeated sign, or an identifier whose parts are numbers or words that the vocabulary spells efficiently.

Spans are in code points, end exclusive, over whole texts. Null and empty texts have no spans, an empty table gives an empty
one; repeated rows give repeated results; spans that start together come in the order of KINDS. A column of the input named
like the new one (in any case) is replaced by it. mask_secrets uses `__text` and `__masked` for itself.
"""

from __future__ import annotations

import base64
import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import passes, prepare, quoted, utf8, with_arrow

KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = [b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"]

#: The token-efficiency test: fewest characters of a candidate, and most characters a token of a random string.
CANDIDATE, RATIO = 20, 2.0
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % CANDIDATE)
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512. (Fixed values.)
DIGESTS = {32, 40, 56, 64, 96, 128}
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)$")
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

IN_RUN = np.zeros(256, bool)
IN_RUN[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"]] = True
IN_HEX = np.zeros(256, bool)
IN_HEX[[*range(48, 58), *range(97, 103)]] = True

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))
SPANS_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    from .bpe import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def long_runs(mask: np.ndarray, ends: np.ndarray, least: int) -> np.ndarray:
    """Starts of runs of at least `least` bytes; a run ends where its text does."""
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1]
    last[:-1] &= ~mask[1:]
    inner = ends[1:-1]
    inner = inner[(inner > 0) & (inner < len(mask))]
    first[inner] |= mask[inner]
    last[inner - 1] |= mask[inner - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    return a[b - a + 1 >= least]


def suspects(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Numbers of texts that can hold a span; all others hold none."""
    found = []
    raw = data.tobytes()
    for where, words in ((raw.lower(), KEYWORDS), (raw, [b"AKIA"])):
        for k in words:
            at = where.find(k)
            while at >= 0:
                found.append(at)
                at = where.find(k, at + 1)
    at = np.concatenate([np.array(found, dtype=np.int64), long_runs(IN_HEX[data], ends, 24), long_runs(IN_RUN[data], ends, CANDIDATE)])
    return np.unique(np.searchsorted(ends, at, "right") - 1)


def ratio(s: str, path: str) -> float:
    return len(s) / len(encoding(path).encode_ordinary(s))


def is_identifier(s: str, path: str) -> bool:
    """A number; or several parts between separators, each a number or made of plain words of three letters or more."""
    parts = [p for p in re.split(r"[+/_=-]+", s) if p]
    plain = lambda w: w.isdigit() or len(w) >= 3 and ratio(w, path) > RATIO
    return len(parts) == 1 and parts[0].isdigit() or len(parts) > 1 and all(p.isdigit() or all(map(plain, PART.findall(p))) for p in parts)


def is_random(s: str, path: str) -> bool:
    if len(set(s)) < 3 or len(s) in DIGESTS and DIGEST.match(s) or UUID.match(s):
        return False
    return ratio(s, path) <= RATIO and not is_identifier(s, path)


def scan(text: str, path: str) -> list[tuple[str, int, int, bool]]:
    out = [("assign", m.start(), m.end(), True) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end(), True) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end(), True) for m in HEX_LONG.finditer(text)]  # a run is a match of HEX; shorter ones fail
    base = sorted((a, b) for _, a, b, _ in out)
    k = 0
    for m in RUN.finditer(text):
        at, end = m.span()
        while k < len(base) and base[k][1] <= at:
            k += 1
        pieces, i = [], k
        while i < len(base) and base[i][0] < end:
            pieces.append((at, base[i][0]))
            at = max(at, base[i][1])
            i += 1
        for a, b in [*pieces, (at, end)]:
            if b - a >= CANDIDATE and is_random(text[a:b], path):
                out.append(("random", a, b, False))
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def scanned(texts: pa.Array, path: str) -> list[list[tuple[str, int, int, bool]]]:
    """The spans of each text."""
    out: list[list] = [[] for _ in range(len(texts))]
    for i, j in passes(texts):
        for k in suspects(*utf8(texts.slice(i, j - i))):
            text = texts[i + int(k)].as_py()
            if text:
                out[i + int(k)] = scan(text, path)
    return out


def find_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secret_spans", vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with an array of spans (kind, start, end, base) by start, then kind as listed in KINDS; base: by a pattern."""
    path = vocabulary or default_vocabulary()
    prepare(docs.sparkSession)

    def run(texts):
        return [pa.array([[dict(zip(("kind", "start", "end", "base"), s)) for s in own] for own in scanned(texts, path)], SPANS_ARROW)]

    return with_arrow(docs, [text_col], [T.StructField(out_col, SPANS)], run, keep)


def mask_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]", vocabulary: str | None = None) -> DataFrame:
    """docs in whose texts each found span (or several that overlap) has become the mask; clean texts stay as they are."""
    path = vocabulary or default_vocabulary()
    prepare(docs.sparkSession)

    def run(texts):
        out = []
        for t, own in zip(texts, scanned(texts, path)):
            s, at, parts = t.as_py(), 0, []
            for _, start, end, _ in own:
                if start >= at:
                    parts += [s[at:start], mask]
                at = max(at, end)
            out.append("".join([*parts, s[at:]]) if own else s)
        return [pa.array(out, pa.string())]

    masked = with_arrow(docs.withColumn("__text", quoted(text_col).cast("string")), ["__text"], [T.StructField("__masked", T.StringType())], run, [c for c in docs.columns if c != text_col])
    return masked.select(*[F.col("__masked").alias(c) if c == text_col else quoted(c) for c in docs.columns])
