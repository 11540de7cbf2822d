"""Text normalisation, tokens and shape tests as Column expressions. Classes are ASCII unless they say otherwise."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Blanks that are more than a single space or another sign: single spaces, which are most, need no replacement.
BLANK = "[\\t\\n\\x0B\\f\\r][ \\t\\n\\x0B\\f\\r]*| [ \\t\\n\\x0B\\f\\r]+"
#: Cyrillic and Greek letters that look like Latin ones, and those: small ones, and capitals that look so only as capitals.
#: (Fixed values: public confusables.)
LOOKALIKES = ("асеорхуіјѕһνοαρτικ" "АВСЕНІЈКМОРЅТХУ" "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aceopxyijshvoaptik" "ABCEHIJKMOPSTXY" "ABEZHIKMNOPTYX")
ZERO_WIDTH = "[\\x{00AD}\\x{200B}-\\x{200F}\\x{202A}-\\x{202E}\\x{2060}-\\x{2064}\\x{FEFF}]"
#: Stands for any letter where a sign has been put in a letter's place.
ANY = "\ue000"
#: Signs that are put in a letter's place. (Fixed values.)
SWAPS = "[013457@$]"
#: A word with one or two of them.
SWAPPED = "^[^013457@$]*[013457@$](?:[^013457@$]*[013457@$])?[^013457@$]*\\z"


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often `then` reads it."""
    return F.get(F.transform(F.array(value), then), 0)


def squeeze(c: Column) -> Column:
    """Blanks collapsed to single spaces, none at either end."""
    return F.trim(F.regexp_replace(c, BLANK, " "))


def dedup_key(c: Column) -> Column:
    """Lower case, [placeholders] dropped, digits as #, blanks collapsed."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), "\\[[^\\]]*\\]", ""), "[0-9]+", "#"))


def token_set(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, " "), lambda t: t != ""))


@functools.lru_cache(maxsize=1)
def _composer(application: str):
    """One function for an application, so that equal calls in a query are one."""

    @F.arrow_udf("string")
    def compose(values: pa.Array) -> pa.Array:
        if pc.all(pc.string_is_ascii(values)).as_py() is not False:
            return values
        # Only the texts that are not ASCII become Python's strings.
        other = pc.fill_null(pc.invert(pc.string_is_ascii(values)), False)
        made = pa.array([unicodedata.normalize("NFKC", t) for t in values.filter(other).to_pylist()], values.type)
        return pc.replace_with_mask(values, other, made)

    return compose


def nfkc(c: Column) -> Column:
    """Compatibility composition; Spark has no built-in form of it. Batches of ASCII alone are passed on as they are."""
    return _composer(SparkSession.active().sparkContext.applicationId)(c)


def normalise(c: Column) -> Column:
    """NFKC, no invisible characters, look-alikes as Latin, letters set apart joined, swapped signs as ANY.

    Applied twice it gives what it gives once. Three or more single letters with one blank, dot, hyphen or underscore between become
    one word. A word with two letters or more and one or two swapped signs has ANY for them, so amounts and numbers stay.
    """
    s, one = "[ ._-]", "[A-Za-z]"
    # Invisible signs and look-alikes are beyond ASCII; characters are compared one by one there, so plain texts are passed on.
    t = squeeze(let(nfkc(c), lambda x: F.when(F.octet_length(x) == F.length(x), x).otherwise(F.translate(F.regexp_replace(x, ZERO_WIDTH, ""), *LOOKALIKES))))
    t = F.regexp_replace(t, f"(?<=(?<!{one}){one}{s}{one}){s}(?={one}(?!{one}))|(?<=(?<!{one}){one}){s}(?={one}{s}{one}(?!{one}))", "")
    swapped = lambda w: F.when(w.rlike(SWAPPED) & w.rlike(f"{one}[^A-Za-z]*{one}"), F.regexp_replace(w, SWAPS, ANY)).otherwise(w)
    return let(t, lambda x: F.when(x.rlike(SWAPS), F.array_join(F.transform(F.split(x, " "), swapped), " ")).otherwise(x))


def keyword(word: str, prefix: bool = False) -> str:
    """A pattern for a whole word in lower-cased text, any letter of which ANY may stand in for."""
    body = "".join(f"[{c}{ANY}]" if c.isalnum() else " " if c == " " else "\\" + c for c in word)
    return f"(?<![a-z0-9{ANY}]){body}" + ("" if prefix else f"(?![a-z0-9{ANY}])")


def has_keyword(t: Column, word: str) -> Column:
    """Whether a lower-cased text has the whole word, as `keyword` reads it. The pattern runs only where it can fit: in texts that
    hold the word's characters or a wildcard."""
    return (t.contains(word) | t.contains(ANY)) & t.rlike(keyword(word))


def words(c: Column, pattern: str = "[a-z]+|[0-9]+|₹|[\\x{0900}-\\x{093B}\\x{093D}-\\x{097F}]+") -> Column:
    """Tokens of lower-cased text, commas within numbers dropped."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(c), "(?<=[0-9]),(?=[0-9])", ""), F.lit(pattern), F.lit(0))


def suggest_language(c: Column, roman: list[str]) -> Column:
    """hi, hinglish or en: by the share of Devanagari letters, then by two or more romanised words."""
    letters = F.regexp_count(c, F.lit("\\p{L}"))
    deva = F.regexp_count(c, F.lit("[\\p{L}&&\\p{IsDevanagari}]"))
    hits = F.regexp_count(F.lower(c), F.lit(f"(?<![A-Za-z0-9_])(?:{'|'.join(roman)})(?![A-Za-z0-9_])"))
    return F.when((letters > 0) & (deva > 0.3 * letters), "hi").when(deva > 0, "hinglish").when(hits >= 2, "hinglish").otherwise("en")


def suggest_obfuscation(c: Column) -> Column:
    spaced = "(?<![A-Za-z0-9_])(?:[A-Za-z][ ._-]){2,}[A-Za-z](?![A-Za-z0-9_])"
    mixed = c.rlike("[A-Za-z]") & c.rlike("[\\x{0370}-\\x{03FF}\\x{0400}-\\x{04FF}]")
    return c.rlike("[A-Za-z][@$][A-Za-z]") | c.rlike("[\\x{200B}-\\x{200D}\\x{FEFF}]") | c.rlike(spaced) | mixed


def link_in(c: Column) -> Column:
    """The first link of a text, trailing punctuation trimmed; empty if none."""
    found = F.regexp_extract(c, "(?i)(?:https?://|upi://|www\\.)[^\\s<>\"]+|(?<![A-Za-z0-9@.-])(?:[a-z0-9-]+\\.)+(?:com|net|org|in|info|xyz|top|io|co|app|link)(?:/[^\\s<>\"]*)?(?![A-Za-z0-9])", 0)
    return F.regexp_replace(found, "[)\\]}>.,;:!?'\"]+$", "")


def visible_text(html: Column) -> Column:
    """Text of a page: no comments, scripts, styles or tags."""
    t = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return squeeze(F.regexp_replace(F.regexp_replace(t, "<[^>]*>", " "), "&amp;", "&"))


def local_references(html: Column) -> Column:
    """Distinct addresses in href and src that stay on the site."""
    found = F.regexp_extract_all(html, F.lit("(?i)(?:href|src)=\"([^\"]+)\""), F.lit(1))
    return F.array_distinct(F.filter(found, lambda a: ~a.rlike("(?i)^(?:[a-z][a-z0-9+.-]*:|//|#)")))


def introduced_name(c: Column, stop: list[str]) -> Column:
    """The name after an introduction, capitalised; null if there is none or it is a common word."""
    n = F.lower(F.regexp_extract(c, "(?i)(?<![A-Za-z])(?:my name is|i am|i'm|this is)\\s+([A-Za-z]{2,20})(?![A-Za-z])", 1))
    return F.when((n != "") & ~n.isin(*stop), F.initcap(n))
