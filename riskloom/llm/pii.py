"""Personal data by a semi-Markov conditional random field.

A text's tokens near digits, `@`, or an ` at ` before a dotted host are cut into segments: single tokens of no kind, or spans of one of KINDS. Features of the
whole span (how many digits, separators, check digit, shape of a host, what stands beside it) score each candidate; dynamic
programming over spans of at most MOST tokens picks boundaries and kinds together. Weights are fitted by the gradient of the
conditional likelihood on at most WINDOWS windows whose spans the fixed patterns mark; in copies of them a phone number has
lost its plus sign or an address its `@`, so that the field also finds spans that the patterns miss. Fixed patterns' spans
(base) are clamped: they are segments of each segmentation, so they are always in the result and added spans stop at them.

Spans are in code points, end exclusive, over whole texts. Null and empty texts have none, and an empty table gives an empty
one; repeated rows give repeated results. An added span has MOST tokens and 24 digits at most (entities are bounded); base
spans have no such limit. Of equally good segmentations the one with fewer, earlier-listed kinds is kept. A column of the input
named like the new one (in any case) is replaced by it. Without windows to learn from, only base spans are found.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import passes, prepare, quoted, utf8, with_arrow
from .secret_scan import SPANS, SPANS_ARROW

KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Windows of the training sample, spans' most tokens, and the code points around a trigger that are segmented.
WINDOWS, MOST, AROUND = 240, 24, 48
#: An added span's least log-odds against leaving its tokens without a kind.
MARGIN = 1.0
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^\sA-Za-z0-9]")
TRIGGER = np.zeros(256, bool)
TRIGGER[[*range(48, 58), 64]] = True
#: An address whose `@` is written out: ` at `, then characters of a host with a dot inside; also over bytes.
WRITTEN = r" [Aa][Tt] (?=[A-Za-z0-9_%+-]*+\.[._%+-]*+[A-Za-z0-9])"
NEAR, NEAR_BYTES = re.compile(r"[0-9@]+|" + WRITTEN), re.compile(WRITTEN.encode())
CUES = {"phone": 0, "tel": 0, "call": 0, "mobile": 0, "fax": 0, "card": 1, "visa": 1, "credit": 1, "mail": 2, "email": 2, "contact": 2, "ip": 3, "host": 3, "server": 3, "version": 4, "v": 4, "id": 4, "no": 4}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def only_digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans, by kind as listed, then start."""
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        a = at
        while a > end and text[a - 1] in LOCAL:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            end = m.end()
            out.append(("email", a, end))
        at = text.find("@", max(at + 1, end))
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
    for m in CARD.finditer(text):
        d = only_digits(m[0]) if len(m[0]) >= 13 else ""
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(only_digits(m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


N_FEATURES = 44


def span_features(text: str, a: int, b: int) -> list[int]:
    """Numbers of the features that hold for text[a:b]; 0 always holds."""
    s = text[a:b]
    d = only_digits(s)
    n = len(d)
    out = [0, 1 + sum(n > k for k in (0, 6, 8, 10, 12, 15, 16, 19))]
    if "@" in s:
        out.append(10 if "." in s[s.index("@") :] else 11)
        out.append(12 if s[0].isalnum() else 13)
    if " at " in s:
        out.append(14)
    out += [15] * (s[0] == "+") + [16] * (s[0] == "(")
    if s.count(".") == 3 and n == len(s) - 3 and all(parts := s.split(".")):
        out.append(17 if all(map(small, parts)) else 18)
    if 13 <= n <= 19:
        out.append(19 if luhn(d) else 20)
    out += [21] * (n == len(s)) + [22] * ("-" in s) + [23] * (" " in s) + [24] * ("." in s) + [25] * ("(" in s)
    out.append(26 if any(c.isalpha() for c in s) else 27)
    left, right = text[a - 1 : a], text[b : b + 2]
    out.append(28 if left.isalnum() else 29 if left in ("+", "(") and left else 30 if left in ("-", ".", "_", "%") and left else 31)
    out.append(32 if right[:1].isalnum() else 33 if right[:1] in ("-", ".", " ") and right[1:].isdigit() else 34)
    word = re.search(r"([A-Za-z]+)[^A-Za-z0-9]{0,3}$", text[max(0, a - 20) : a])
    if word and (cue := CUES.get(word[1].lower())) is not None:
        out.append(35 + cue)
    groups = re.findall(r"[0-9]+", s)
    if len(groups) > 1:
        out.append(40 if all(len(g) == 4 for g in groups) else 41)
    if 9 <= n <= 15:
        out.append(42)
    if s.count(" ") > 4:
        out.append(43)
    return out


def candidates(text: str, tokens: list[tuple[int, int]]) -> dict[int, list[tuple[int, list[int], list[int]]]]:
    """By end token: (start token, kinds it may have, features)."""
    out: dict[int, list] = {}
    n = len(tokens)
    chars = [text[a] for a, _ in tokens]

    def add(i: int, j: int, kinds: list[int]) -> None:
        a, b = tokens[i][0], tokens[j - 1][1]
        out.setdefault(j, []).append((i, kinds, span_features(text, a, b)))

    for i in range(n):
        if chars[i].isdigit() and chars[i].isascii() or chars[i] in "+(":
            digits = 0
            for j in range(i, min(n, i + MOST)):
                a, b = tokens[j]
                if chars[j].isdigit() and chars[j].isascii():
                    digits += b - a
                    if digits > 24:
                        break
                    if digits >= 7 or digits >= 4 and text.count(".", tokens[i][0], b) == 3:
                        add(i, j + 1, [1, 2, 3])
                elif not (chars[j] in "-.()" or text[a:b] == " " or j == i and chars[j] == "+"):
                    break
        at = chars[i] == "@" or text[tokens[i][0] : tokens[i][1]].lower() == "at" and 0 < i < n - 1 and text[tokens[i - 1][0] : tokens[i + 1][1]].lower() == " at "
        if at:
            wide = 0 if chars[i] == "@" else 1
            starts, k = [], i - 1 - wide
            while k >= 0 and i - k <= MOST // 2 and chars[k] in LOCAL:
                starts.append(k)
                k -= 1
            ends, k, dot = [], i + 1 + wide, False
            while k < n and k - i <= MOST // 2 and (chars[k] in LOCAL):
                dot |= chars[k] == "."
                if chars[k].isalnum() and dot:
                    ends.append(k + 1)
                k += 1
            for s in starts:
                for e in ends:
                    add(s, e, [0])
    return out


class Field:
    """Weights of each kind's span features, and of two spans side by side."""

    def __init__(self):
        self.w = np.zeros((len(KINDS), N_FEATURES))
        self.side = -1.0
        self.fitted = False

    def scores(self, cands: dict) -> dict[int, list[tuple[int, int, float, list[int]]]]:
        w = self.w
        return {j: [(i, k, float(w[k, f].sum()), f) for i, kinds, f in own for k in kinds] for j, own in cands.items()}

    def gradient(self, n: int, scored: dict, gold: set[tuple[int, int, int]], grad: np.ndarray) -> None:
        """Adds observed less expected features of one window. States: 0 after a token of no kind, 1 after a span."""
        low = -1e30
        a = [[0.0, low]] + [[low, low] for _ in range(n)]
        plus = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y))) if min(x, y) > low / 2 else max(x, y)
        for j in range(1, n + 1):
            a[j][0] = plus(*a[j - 1])
            for i, _, s, _ in scored.get(j, ()):
                a[j][1] = plus(a[j][1], plus(a[i][0], a[i][1] + self.side) + s)
        b = [[low, low] for _ in range(n)] + [[0.0, 0.0]]
        starts: dict[int, list] = {}
        for j, own in scored.items():
            for i, k, s, f in own:
                starts.setdefault(i, []).append((j, k, s, f))
        for i in range(n - 1, -1, -1):
            b[i][0] = b[i][1] = b[i + 1][0]
            for j, _, s, _ in starts.get(i, ()):
                b[i][0] = plus(b[i][0], b[j][1] + s)
                b[i][1] = plus(b[i][1], b[j][1] + s + self.side)
        z = plus(*a[n])
        for i, own in starts.items():
            enter = plus(a[i][0], a[i][1] + self.side)
            for j, k, s, f in own:
                p = math.exp(min(0.0, enter + s + b[j][1] - z))
                for x in f:
                    grad[k, x] += ((i, j, k) in gold) - p

    def fit(self, windows: list[str], epochs: int = 6, rate: float = 0.3) -> None:
        made = []
        for w in windows:
            for text, spans in lessons(w):
                tokens = [m.span() for m in TOKEN.finditer(text)]
                begin, end = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
                gold = {(begin[a], end[b], KINDS.index(k)) for k, a, b in spans if a in begin and b in end}
                cands = candidates(text, tokens)
                for i, j, k in gold:
                    if not any(i == x and k in kinds for x, kinds, _ in cands.get(j, ())):
                        cands.setdefault(j, []).append((i, [k], span_features(text, tokens[i][0], tokens[j - 1][1])))
                if cands:
                    made.append((len(tokens), cands, gold))
        total = np.full_like(self.w, 1e-6)
        for _ in range(epochs if made else 0):
            for at in range(0, len(made), 8):
                grad = -1e-3 * self.w
                for n, cands, gold in made[at : at + 8]:
                    self.gradient(n, self.scores(cands), gold, grad)
                total += grad**2
                self.w += rate * grad / np.sqrt(total)
            self.fitted = True

    def decode(self, text: str, lo: int, hi: int, fixed: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
        """The best segmentation's spans in text[lo:hi] besides the fixed ones; features look beyond the edges."""
        if not self.fitted:
            return []
        tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, lo, hi)]
        held = [0]
        for a, b in tokens:
            held.append(held[-1] + any(x < b and a < y for x, y in fixed))
        cands = {j: own for j, all_ in candidates(text, tokens).items() if (own := [c for c in all_ if held[c[0]] == held[j]])}
        if not cands:
            return []
        n, best, back = len(tokens), [[0.0, -1e30]], [[None, None]]
        scored = self.scores(cands)
        for j in range(1, n + 1):
            if held[j] > held[j - 1]:
                # A fixed span's token: the state after it is that after a span.
                p = int(best[j - 1][1] + self.side * (j < 2 or held[j - 1] == held[j - 2]) > best[j - 1][0])
                best.append([-1e30, best[j - 1][p] + self.side * p * (j < 2 or held[j - 1] == held[j - 2])])
                back.append([None, (j - 1, p, None)])
                continue
            p = int(best[j - 1][1] > best[j - 1][0])
            row, ways = [best[j - 1][p], -1e30], [(j - 1, p, None), None]
            for i, k, s, _ in scored.get(j, ()):
                q = int(best[i][1] + self.side > best[i][0])
                v = best[i][q] + self.side * q + s - MARGIN
                if v > row[1]:
                    row[1], ways[1] = v, (i, q, k)
            best.append(row)
            back.append(ways)
        out, j, state = [], n, int(best[n][1] > best[n][0])
        while j > 0:
            i, q, k = back[j][state]
            if k is not None:
                out.append((KINDS[k], tokens[i][0], tokens[j - 1][1]))
            j, state = i, q
        return out[::-1]


def lessons(window: str) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """The window with its base spans, and copies in which a span is written in a way the patterns don't know."""
    spans: list[tuple[str, int, int]] = []
    for k, a, b in sorted(base_spans(window), key=lambda x: (KINDS.index(x[0]), x[1])):
        if all(b <= c or d <= a for _, c, d in spans):
            spans.append((k, a, b))
    out = [(window, spans)]
    for k, a, b in spans:
        if k == "phone":
            out.append((window[:a] + window[a + 1 :], [(x, c - (c > a), d - (d > a)) for x, c, d in spans]))
        elif k == "email":
            at = window.index("@", a, b)
            out.append((window[:at] + " at " + window[at + 1 :], [(x, c + 3 * (c > at), d + 3 * (d > at)) for x, c, d in spans]))
    return out


def fit_field(docs: DataFrame, text_col: str, id_col: str, windows: int = WINDOWS) -> Field:
    """A field fitted on the first digit's or `@`'s surroundings of at most `windows` texts: those whose ids hash lowest.

    Ids are ranked first; windows are cut from the chosen texts only.
    """
    text, hashed = quoted(text_col).cast("string"), F.xxhash64(quoted(id_col))
    own = docs.where(text.rlike("[0-9@]")).select(hashed.alias("h"), text.alias("t"))
    low = [r["h"] for r in own.select("h").orderBy("h").limit(windows).collect()]
    at = F.length(F.regexp_extract("t", "^[^0-9@]*+", 0)) + 1
    cut = F.substr("t", F.greatest(F.lit(1), at - 60), F.least(F.lit(60), at - 1) + 181)
    got = own.where(F.col("h").isin(sorted(set(low)))).select("h", cut.alias("w")).orderBy("h", "w").limit(windows).collect() if low else []
    field = Field()
    field.fit(sorted(r["w"] for r in got))
    return field


def scan(text: str, field: Field) -> list[tuple[str, int, int, bool]]:
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    out = [(k, a, b, True) for k, a, b in base]
    regions: list[list[int]] = []
    for m in NEAR.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if regions and a <= regions[-1][1]:
            regions[-1][1] = b
        else:
            regions.append([a, b])
    reach = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
    starts = [a for a, _ in taken]
    for lo, hi in regions:
        fixed = taken[bisect_right(reach, lo) : bisect_right(starts, hi - 1)]
        out += [(k, a, b, False) for k, a, b in field.decode(text, lo, hi, fixed)]
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def find_pii(docs: DataFrame, field: Field, text_col: str = "text", out_col: str = "pii_spans", keep: list[str] | None = None) -> DataFrame:
    """docs with an array of spans (kind, start, end, base) by kind as listed in KINDS, then start; base: by a fixed pattern."""
    prepare(docs.sparkSession)

    def run(texts):
        out: list[list] = [[] for _ in range(len(texts))]
        for i, j in passes(texts):
            data, ends = utf8(texts.slice(i, j - i))
            at = np.concatenate([np.flatnonzero(TRIGGER[data]), np.array([m.start() for m in NEAR_BYTES.finditer(data.tobytes())], dtype=np.int64)])
            for k in np.unique(np.searchsorted(ends, at, "right") - 1):
                out[i + int(k)] = [dict(zip(("kind", "start", "end", "base"), s)) for s in scan(texts[i + int(k)].as_py(), field)]
        return [pa.array(out, SPANS_ARROW)]

    return with_arrow(docs, [text_col], [T.StructField(out_col, SPANS)], run, keep)
