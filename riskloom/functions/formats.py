"""Numbers, dates and times as the pages show them: lakh and crore grouping, long dates, clock times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAKH, CRORE = 100_000, 10_000_000


def fixed(n: Column, decimals: int) -> Column:
    """n with that many decimals, halves rounded away from zero, ungrouped."""
    return F.format_string(f"%.{decimals}f", n.cast("double"))


def indian(n: Column, decimals: int = 0) -> Column:
    """101928 as 1,01,928: the last three digits, then pairs. Null for null and for what is not finite."""
    text = fixed(F.abs(n), decimals)
    whole = F.substring_index(text, ".", 1)
    head = F.regexp_replace(F.substr(whole, F.lit(1), F.greatest(F.lit(0), F.length(whole) - 3)), r"(\d)(?=(\d{2})+$)", "$1,")
    grouped = F.when(F.length(whole) > 3, F.concat(head, F.lit(","), F.right(whole, F.lit(3)))).otherwise(whole)
    fraction = F.substr(text, F.length(whole) + 1)
    d = n.cast("double")
    finite = ~F.isnan(d) & (F.abs(d) != float("inf"))
    return F.when(finite, F.concat(F.when(n < 0, "-").otherwise(""), grouped, fraction))


def rupees_compact(n: Column) -> Column:
    """Rupees with a sign, in lakh from 100,000 and crore from 10,000,000 on; null below 0."""
    return F.when(n >= CRORE, F.concat(F.lit("₹"), fixed(n / CRORE, 2), F.lit(" Cr"))).when(n >= LAKH, F.concat(F.lit("₹"), fixed(n / LAKH, 2), F.lit(" Lakh"))).when(
        n >= 0, F.concat(F.lit("₹"), indian(F.floor(n)))
    )


def counter(n: Column) -> Column:
    """The running counter's text: as rupees_compact without the sign."""
    return F.when(n >= CRORE, F.concat(fixed(n / CRORE, 2), F.lit(" Cr"))).when(n >= LAKH, F.concat(fixed(n / LAKH, 2), F.lit(" Lakh"))).otherwise(indian(F.floor(n)))


def stat(n: Column, fmt: str) -> Column:
    """A figure in a named format; an unknown name fails."""
    around = lambda before, c, after: F.concat(F.lit(before), c, F.lit(after))
    plain = F.regexp_replace(n.cast("string"), r"\.0$", "")
    formats = {
        "inr_cr": around("₹", indian(n), " Cr"), "inr_crore": around("₹", indian(n), " Crore"), "inr_cr_tight": around("₹", indian(n), "Cr"), "num": indian(n),
        "lakh": around("", fixed(n / LAKH, 2), " lakh"), "lakh_title": around("", fixed(n / LAKH, 2), " Lakh"), "lakh_tight": around("", fixed(n / LAKH, 2), "L"),
        "pct": around("", plain, "%"), "bn": around("", fixed(n, 2), " billion"), "inr_lakh_crore": around("₹", fixed(n, 2), " lakh crore"), "inr": around("₹", indian(n), ""), "plain": plain,
    }
    if fmt not in formats:
        raise ValueError(f"unknown format {fmt!r}")
    return formats[fmt]


def long_date(day: Column) -> Column:
    """2024-03-05 as 5 March 2024."""
    return F.date_format(day, "d MMMM yyyy")


def weekday(day: Column) -> Column:
    return F.date_format(day, "EEEE")


def clock(hhmm: Column) -> Column:
    """12:42 as 12:42 pm; null for what is no time of 24 hours."""
    hour = F.substring(hhmm, 1, 2).try_cast("int")
    shown = F.when(hour % 12 == 0, 12).otherwise(hour % 12)
    return F.when(hhmm.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.concat(shown.cast("string"), F.substring(hhmm, 3, 3), F.when(hour < 12, " am").otherwise(" pm")))
