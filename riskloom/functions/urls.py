"""Addresses taken apart, public suffixes, look-alikes, as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import LOOKALIKES

#: Public suffixes of two labels that matter here, and domains open to registered bodies only. (Fixed values.)
DOUBLE_SUFFIXES = ["ac.in", "bank.in", "co.in", "co.uk", "com.au", "fin.in", "firm.in", "gen.in", "gov.in", "ind.in", "net.in", "nic.in", "org.in", "org.uk"]
GOVERNMENT = ["gov.in", "nic.in"]
FINANCE = ["bank.in", "fin.in"]
EDGES = "^[<\"'(\\[]+|[>\"')\\].,;!]+$"


def cleaned(c: Column) -> Column:
    """Without the blanks, brackets and punctuation that stand around a pasted link."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", ""), EDGES, "")


def scheme(c: Column) -> Column:
    """Lower-case scheme; empty for none, or for host:port."""
    return F.when(c.rlike("^[A-Za-z0-9.-]+:[0-9]+"), "").otherwise(F.lower(F.regexp_extract(c, "^([A-Za-z][A-Za-z0-9+.-]*):", 1)))


def absolute(c: Column) -> Column:
    """With a scheme, and slashes where browsers read backslashes as such."""
    return F.translate(F.when(scheme(c) == "", F.concat(F.lit("http://"), c)).otherwise(c), "\\", "/")


def authority(c: Column) -> Column:
    return F.regexp_extract(absolute(c), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def userinfo(c: Column) -> Column:
    return F.regexp_extract(authority(c), "^(.*)@", 1)


def host(c: Column) -> Column:
    """Lower case, without user, port, last dot and www."""
    h = F.regexp_replace(F.regexp_replace(authority(c), "^.*@", ""), ":[0-9]*$", "")
    return F.regexp_replace(F.regexp_replace(F.lower(h), "[.]$", ""), "^www[.]", "")


def path(c: Column) -> Column:
    return F.regexp_extract(absolute(c), "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(c: Column) -> Column:
    return F.regexp_extract(absolute(c), "^[^?#]*[?]([^#]*)", 1)


def decoded(c: Column) -> Column:
    """Percent escapes resolved, a plus sign kept; as it is if an escape is damaged."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(c, "[+]", "%2B")), c)


def registrable(h: Column) -> Column:
    """The label before the public suffix, and the suffix."""
    labels = F.split(h, "[.]")
    n = F.size(labels)
    two = F.array_join(F.slice(labels, F.greatest(F.lit(1), n - 1), F.lit(2)), ".")
    keep = F.when(two.isin(*DOUBLE_SUFFIXES), 3).otherwise(2)
    return F.when(n <= 2, h).otherwise(F.array_join(F.slice(labels, F.greatest(F.lit(1), n - keep + 1), keep), "."))


def host_suffixes(h: Column) -> Column:
    """The host and each domain above it."""
    labels = F.split(h, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def folded(c: Column) -> Column:
    """Look-alike letters of other scripts, 0 and 1, as Latin letters."""
    return F.translate(c, LOOKALIKES[0] + "01", LOOKALIKES[1] + "ol")


def unicode_host(h: Column) -> Column:
    """xn-- labels as the letters that a reader sees; a damaged label stays."""

    def label(s: str) -> str:
        if not s.startswith("xn--"):
            return s
        try:
            return s[4:].encode("ascii").decode("punycode")
        except (UnicodeError, ValueError, OverflowError):
            return s

    @F.pandas_udf("string")
    def show(hosts: pd.Series) -> pd.Series:
        return hosts.map(lambda h: h if h is None or "xn--" not in h else ".".join(map(label, h.split("."))))

    return F.when(h.contains("xn--"), show(h)).otherwise(h)


def one_edit(a: Column, b: Column) -> Column:
    """Equal but for one letter more, less or other, or two neighbours swapped."""
    n = F.length(a)
    swapped = F.exists(F.when(n > 1, F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substr(a, F.lit(1), i - 1), F.substr(a, i + 1, F.lit(1)), F.substr(a, i, F.lit(1)), F.substr(a, i + 2)) == b)
    return (F.levenshtein(a, b, 1) >= 0) | ((n == F.length(b)) & swapped)


def fnv1a(c: Column) -> Column:
    """FNV-1a of 32 bits over ASCII characters."""
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * 16777619).bitwiseAND(F.lit(4294967295)))
