"""Personal data in messages: flags, masking by placeholders, small cells.

What a piece of text is follows from a table of shapes (MASKS): rows in order of precedence, each a placeholder and a pattern of
what it stands for. Masking replaces them row by row inside the JVM; no later shape can match a placeholder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Placeholders that masked texts may hold. (Fixed values.)
PLACEHOLDERS = ["ACCOUNT", "ADDRESS", "CARD", "EMAIL", "HANDLE", "ID_NUMBER", "NAME", "OTP", "PAN", "PHONE", "UPI"]
#: What follows the `@` of payment addresses, by provider: as apps and banks publish them with the payment system's operator.
#: Written from general knowledge; not checked against their lists.
PAYMENT_HANDLES = {
    "PhonePe": ["ybl", "ibl", "axl"], "Google Pay": ["okaxis", "okhdfcbank", "okicici", "oksbi"], "Paytm": ["paytm", "ptaxis", "pthdfc", "ptsbi", "ptyes"], "Amazon Pay": ["apl", "yapl", "rapl"],
    "WhatsApp": ["waaxis", "wahdfcbank", "waicici", "wasbi"], "BHIM": ["upi"], "CRED": ["axisb", "yescred"], "Jupiter": ["jupiteraxis"], "MobiKwik": ["ikwik"], "Freecharge": ["freecharge"], "Airtel": ["airtel"],
    "banks": ["sbi", "icici", "hdfcbank", "kotak", "axisbank", "barodampay", "pnb", "cnrb", "unionbank", "idfcbank", "federal", "indus", "yesbank", "rbl", "dbs", "citi", "hsbc", "sc", "aubank", "equitas", "kbl", "kvb", "uco", "mahb", "cboi"],
}
SUFFIXES = [s for own in PAYMENT_HANDLES.values() for s in own]
LEFT, WORD = "[A-Za-z0-9._-]", "[A-Za-z0-9_]"
ADDRESS = "([A-Za-z0-9._-]*)@([A-Za-z0-9.-]*)"
#: The same matches: one begins where a run of LEFT does or the match before ended, so a run is read once and not from each character.
ADDRESS_ONCE = f"(?:(?<!{LEFT})|\\G)({LEFT}*+)@([A-Za-z0-9.-]*+)"
#: An `@` that nothing of an address stands before. The sign comes first, as it is rare.
HANDLE = f"@(?<!{LEFT}@)[A-Za-z0-9.-]"


def digits(first: str, least: int, most: int | None = None) -> str:
    """A run that begins with `first` and goes on with `least` to `most` digits, one blank or hyphen between; nothing of it left over."""
    return f"(?<![0-9])(?<![0-9][ -]){first}(?:[ -]?[0-9]){{{least},{'' if most is None else most}}}(?![ -]?[0-9])"


#: Placeholder, pattern, and what of the match stays before the placeholder.
MASKS = [
    ("OTP", f"(?i)(?<!{WORD})((?:otp|cvv|verification code|one[- ]time (?:code|password))(?: *(?:code|is|no|number))? *[:=-]? *)[0-9]{{3,8}}(?!{WORD})", "$1"),
    ("HANDLE", f"(?<!{LEFT})@[A-Za-z0-9._]*{WORD}", ""),
    ("EMAIL", f"{LEFT}+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]*[A-Za-z0-9])+", ""),
    ("UPI", f"(?i){LEFT}+@(?:{'|'.join(SUFFIXES)})(?![A-Za-z0-9-])", ""),
    ("UPI", f"(?<!{LEFT})(?=[A-Za-z]*[0-9._-]){LEFT}+@[A-Za-z0-9-]*[A-Za-z0-9]", ""),
    ("PAN", f"(?<!{WORD})[A-Z]{{5}}[0-9]{{4}}[A-Z](?!{WORD})", ""),
    ("ACCOUNT", f"(?:[Xx*•]{{2,}}[ -]?)+[0-9]{{2,6}}(?!{WORD})", ""),
    ("PHONE", digits("[+][0-9]", 9, 13), ""),  # with a country's code
    ("PHONE", digits("[+]?[6-9]", 9, 9), ""),  # a mobile number
    ("PHONE", digits("[+]?9[ -]?1[ -]?[6-9]", 9, 9), ""),
    ("PHONE", digits("[+]?0", 9, 12), ""),  # a trunk call
    ("PHONE", digits("[+]?1[ -]?8[ -]?[06][ -]?0", 6, 7), ""),  # toll-free
    ("ID_NUMBER", digits("[+]?[0-9]", 11, 11), ""),
    ("CARD", digits("[+]?[0-9]", 14, 15), ""),
    ("ACCOUNT", digits("[+]?[0-9]", 8), ""),
]
#: What a text must hold to be touched by the next so many of MASKS: most texts hold none of it.
GUARDS = [(1, "[0-9]{3}"), (4, "@"), (2, "[0-9]{2}"), (8, "[0-9](?:[ -]?[0-9]){8}")]


def pii_flags(t: Column) -> dict[str, Column]:
    """What a masked text must not hold: a long digit run, a handle, an address, a PAN, an unknown placeholder, glued text."""
    sides = [F.regexp_extract_all(t, F.lit(ADDRESS_ONCE), F.lit(k)) for k in (1, 2)]
    personal = F.zip_with(*sides, lambda left, right: (left != "") & (F.lower(right).isin(*SUFFIXES) | left.rlike("[0-9._-]") | right.contains(".")))
    at = t.contains("@")
    named = F.regexp_extract_all(t, F.lit("\\[([^\\]]*)\\]"), F.lit(1))
    return {
        "digits": t.rlike("[0-9](?:[ -]?[0-9]){8,}"), "handle": at & t.rlike(HANDLE), "address": F.when(at, F.exists(personal, lambda x: x)).otherwise(at),
        "pan": t.rlike(f"(?<!{WORD})[A-Z]{{5}}[0-9]{{4}}[A-Z](?!{WORD})"), "unknown_placeholder": F.size(F.array_except(named, F.array(*[F.lit(p) for p in PLACEHOLDERS]))) > 0,
        "glued": t.rlike("\\[[A-Z_]+\\][A-Za-z0-9_]"),
    }


def scrub(df: DataFrame, text_col: str) -> DataFrame:
    """df with masked and counts (placeholder to number, of those that were put in). Masking again changes nothing; a null stays null."""
    d, masks = df.withColumn("__0", F.col(text_col)), iter(MASKS)
    for k, (n, guard) in enumerate(GUARDS):
        t = F.col(f"__{k}")
        step = t
        for _, (label, pattern, before) in zip(range(n), masks):
            step = F.regexp_replace(step, pattern, f"{before}[{label}]")
        # Each step's text is a column: it is used twice, and made once.
        d = d.withColumn(f"__{k + 1}", F.when(t.rlike(guard), step).otherwise(t))
    d = d.withColumn("masked", F.col(f"__{len(GUARDS)}")).drop(*[f"__{k}" for k in range(len(GUARDS) + 1)])
    same = F.col("masked").isNull() | (F.col("masked") == F.col(text_col))
    of = lambda c, label: F.regexp_count(c, F.lit(f"\\[{label}\\]"))
    more = F.array(*[F.struct(F.lit(p).alias("key"), (of(F.col("masked"), p) - of(F.col(text_col), p)).cast("long").alias("value")) for p in sorted({m[0] for m in MASKS})])
    counted = F.map_from_entries(F.filter(more, lambda x: x["value"] > 0))
    return d.withColumn("counts", F.when(same, F.create_map().cast("map<string,bigint>")).otherwise(counted))


def left_over(df: DataFrame, masked_col: str = "masked") -> DataFrame:
    """df with the names of what the masked text still holds."""
    flags = pii_flags(F.col(masked_col))
    return df.withColumn("left_over", F.filter(F.array(*[F.when(x, k) for k, x in flags.items()]), lambda x: x.isNotNull()))


def mask_terms(t: Column, terms: list[str], placeholder: str) -> Column:
    """Each term (two characters or more), in any case, as the placeholder."""
    for term in terms:
        if len(term.strip()) < 2:
            raise ValueError("a term needs two characters")
        t = F.regexp_replace(t, "(?i)\\Q" + term.strip().replace("\\E", "\\E\\\\E\\Q") + "\\E", f"[{placeholder}]")
    return t


def small_cells(n: Column, least: int = 5) -> Column:
    """A count as text; one below `least` (but not 0) isn't told."""
    return F.when(n.between(1, least - 1), f"<{least}").otherwise(n.cast("string"))
