"""BPE encoding and decoding by tree concatenation.

Texts up to LEAF code points are encoded where they are read. A longer text is cut into leaves, and the leaves are rows of
their own, encoded in parallel on any executor. Where the pretokenizer's pattern always splits (a space after another
character), a cut needs no repair. A stretch without such a place ("unsplit text") is pretokenized, and a long pretoken
becomes leaves that are joined pairwise, level by level: around each join a window of tokens is encoded again and grows
until its first token is the left side's and its last token the right side's. Byte-level BPE is exact when each two
neighbouring tokens are what their bytes encode to, so tokens beyond an agreeing window stay as they are.

Null text counts as empty; empty text has no tokens. Repeated rows give repeated results. The special token's string in a
text is that token, as the tokenizers library has it by default.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, quoted, with_arrow

#: Code points above which a text's parts are encoded as rows of their own.
LEAF = 32_768
#: Bytes of a pretoken above which it is encoded by halves.
PIECE = 4_096

#: The GPT-2 pretokenizer's pattern. (Fixed value.)
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Tokens' bytes and special tokens' strings, each with its id, of a tokenizers JSON file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in specials}, specials


class ByteBpe:
    """A byte-level BPE of a tokenizers JSON file, run by tiktoken."""

    def __init__(self, path: str):
        import tiktoken

        ranks, specials = read_vocabulary(path)
        self.enc = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)
        self.specials = specials
        self.piece = self.enc._core_bpe.encode_single_piece
        self.bytes_of = {i: b for b, i in ranks.items()}

    def parts(self, text: str) -> list[tuple[int | None, str]]:
        """The text cut at special tokens: (id, "") for one of them, (None, part) for what is between."""
        todo: list[tuple[int | None, str]] = [(None, text)]
        for s, i in self.specials.items():
            if s in text:
                todo = [x for k, part in todo for x in ([(k, part)] if k is not None else [y for j, p in enumerate(part.split(s)) for y in ([(i, ""), (None, p)] if j else [(None, p)])])]
        return [(k, p) for k, p in todo if k is not None or p]

    def encode(self, text: str) -> list[int]:
        """Whole text, cut into leaves and joined as the distributed path does."""
        if len(text) <= PIECE and not any(s in text for s in self.specials):
            return self.enc.encode_ordinary(text)
        out: list[int] = []
        for k, part in self.parts(text):
            out += [k] if k is not None else self.enc.encode_ordinary(part) if len(part) <= PIECE or not self.unsplit(part) else self.joined([(w, self.leaf(w, b)) for w, b in self.leaves(part)])
        return out

    @staticmethod
    def unsplit(text: str) -> bool:
        """Whether some stretch of more than PIECE code points has no plain space or line end."""
        at, n = 0, len(text)
        while n - at > PIECE:
            cut = max(text.rfind(" ", at, at + PIECE), text.rfind("\n", at, at + PIECE))
            if cut <= at:
                return True
            at = cut
        return False

    def leaves(self, text: str, most: int = PIECE) -> list[tuple[int, bytes]]:
        """(0, bytes) for a leaf that stands alone; (n, bytes) for a leaf of the n-th long pretoken."""
        import regex

        out, at, n, long = [], 0, len(text), 0
        while at < n:
            if n - at <= most:
                stop = n
            else:
                stop = self.split_place(text, at + most // 2, at + most)
            if stop:
                out.append((0, text[at:stop].encode()))
                at = stop
                continue
            stop = self.split_place(text, at + most, n) or n
            for m in regex.finditer(PATTERN, text[at:stop]):
                raw = m[0].encode()
                if len(raw) <= PIECE:
                    out.append((-1, raw))
                else:
                    long += 1
                    out += [(long, raw[i : i + PIECE]) for i in range(0, len(raw), PIECE)]
            at = stop
        return out

    @staticmethod
    def split_place(text: str, low: int, high: int) -> int:
        """The first place in low..high where a space follows another character, else 0: the pattern always splits there."""
        at = text.find(" ", low, high)
        while at > 0:
            if not text[at - 1].isspace():
                return at
            at = text.find(" ", at + 1, high)
        return 0

    def leaf(self, which: int, raw: bytes) -> list[int]:
        return self.enc.encode_ordinary(raw.decode()) if which == 0 else self.piece(raw)

    def joined(self, leaves: list[tuple[int, list[int]]]) -> list[int]:
        """All tokens of a text whose leaves are given in order."""
        out: list[int] = []
        i = 0
        while i < len(leaves):
            which, ids = leaves[i]
            i += 1
            if which <= 0:
                out += ids
                continue
            level = [ids]
            while i < len(leaves) and leaves[i][0] == which:
                level.append(leaves[i][1])
                i += 1
            while len(level) > 1:
                level = [self.join(level[k], level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
            out += level[0]
        return out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Tokens of left's and right's bytes together, by growing windows around the join."""
        k = 4
        while True:
            a, b = min(k, len(left)), min(k, len(right))
            window = self.piece(b"".join(self.bytes_of[i] for i in [*left[len(left) - a :], *right[:b]]))
            if (a == len(left) or window[0] == left[-a]) and (b == len(right) or window[-1] == right[b - 1]):
                return [*left[: len(left) - a], *window, *right[b:]]
            k *= 2

@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id: all that decoding needs."""
    ranks, specials = read_vocabulary(path)
    return {i: b for b, i in ranks.items()} | {i: s.encode() for s, i in specials.items()}


def decode(ids: np.ndarray, path: str) -> str:
    return b"".join(map(token_bytes(path).__getitem__, ids.tolist())).decode("utf-8", errors="replace")


def packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


IDS = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType())]


def bpe_encode(docs: DataFrame, text_col: str = "text", vocabulary: str | None = None, leaf: int = LEAF, keep: list[str] | None = None) -> DataFrame:
    """docs with ids (binary: little-endian unsigned 32-bit integers) and n_tokens; other columns stay, or those in keep."""
    path = vocabulary or default_vocabulary()
    prepare(docs.sparkSession)
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    is_long = F.length(text) > leaf

    def here(texts):
        encode = tokenizer(path).encode
        ids = [packed(encode(t.as_py() or "")) for t in texts]
        return pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())

    short = with_arrow(docs.where(~is_long), [text_col], IDS, here, keep)

    # Long texts: each different one once, its leaves over all executors, then joined by the text's digest.
    long = docs.where(is_long).withColumn("__key", F.sha2(text, 256))

    def to_leaves(batches):
        for b in batches:
            tok = tokenizer(path)
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, n = [], 0
                for k, part in tok.parts(t):
                    base = n + 1
                    for which, raw in [(k, b"")] if k is not None else tok.leaves(part, leaf):
                        kind = "special" if k is not None else "text" if which == 0 else "piece"
                        n += 1
                        rows.append((key, n, kind, which if k is not None else base + which if which > 0 else -1, raw))
                for i in range(0, len(rows), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 256]), (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.binary()))], ["__key", "seq", "kind", "which", "raw"])

    def encode_leaves(batches):
        for b in batches:
            tok = tokenizer(path)
            ids = [packed([w] if kind == "special" else tok.leaf(0 if kind == "text" else 1, raw)) for kind, w, raw in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(ids, pa.binary())], ["__key", "seq", "kind", "which", "ids"])

    def join_leaves(t: pa.Table) -> pa.Table:
        t = t.sort_by("seq")
        tok = tokenizer(path)
        ids = tok.joined([(w if kind == "piece" else 0, np.frombuffer(raw, "<u4").tolist()) for kind, w, raw in zip(t["kind"].to_pylist(), t["which"].to_pylist(), t["ids"].to_pylist())])
        return pa.table({"__key": [t["__key"][0].as_py()], "ids": pa.array([packed(ids)], pa.binary()), "n_tokens": pa.array([len(ids)], pa.int64())})

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = (
        long.select("__key", text.alias("t")).dropDuplicates(["__key"])
        .mapInArrow(to_leaves, "__key string, seq int, kind string, which bigint, raw binary")
        .repartition(n)
        .mapInArrow(encode_leaves, "__key string, seq int, kind string, which bigint, ids binary")
    )
    whole = leaves.groupBy("__key").applyInArrow(join_leaves, "__key string, ids binary, n_tokens bigint")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("ids", "n_tokens")]
    rest = long.select(*[quoted(c) for c in kept], "__key").join(whole, "__key").drop("__key")
    return short.unionByName(rest)


def bpe_decode(df: DataFrame, ids_col: str = "ids", out_col: str = "decoded", vocabulary: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """df with the text that each row's ids stand for; null ids give an empty text."""
    path = vocabulary or default_vocabulary()
    prepare(df.sparkSession)

    def run(ids):
        return [pa.array([decode(np.frombuffer(x.as_py() or b"", "<u4"), path) for x in ids], pa.string())]

    return with_arrow(df, [ids_col], [T.StructField(out_col, T.StringType())], run, keep)
