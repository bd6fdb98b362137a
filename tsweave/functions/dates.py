"""Messy text to timestamps, as Column expressions.

Each layout is a regular expression with named places. Groups are extracted
and handed to ``try_make_timestamp_ntz``, which gives null for impossible dates;
the first layout that yields a timestamp wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The pieces a layout is made of. Every piece is one group.
DAY = r"(3[0-1]|[1-2][0-9]|0[1-9]|[1-9]| [1-9])"
MONTH = r"(1[0-2]|0[1-9]|[1-9])"
YEAR = r"([0-9]{4})"
YEAR2 = r"([0-9]{2})"
MON = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
MONTH_NAME = (
    r"(january|february|march|april|may|june|july|august|september|october|november|december)"
)
HOUR = r"([0-1]?[0-9]|2[0-3])"
MINUTE = r"([0-5]?[0-9])"
SECOND = r"([0-5]?[0-9](?:\.[0-9]{1,6})?)"
AMPM = r"(am|pm)"

PIECES = {
    "d": DAY, "m": MONTH, "Y": YEAR, "y": YEAR2, "b": MON, "B": MONTH_NAME,
    "H": HOUR, "M": MINUTE, "S": SECOND, "p": AMPM,
}

# Substring layouts in the order they are tried, earlier ones
# shadowing later ones. Layouts with a time of day can never be reached behind
# the plain dates and are left out, so the time of day is always lost.
FIRST_MATCH = [
    "{b}-{y}", "{Y}-{m}-{d}", "{d}-{m}-{Y}", "{m}/{d}/{Y}", "{Y}/{m}/{d}",
    r"{B}\s+{d},\s+{Y}", "{d}-{b}-{Y}", r"{b}\s+{d},\s+{Y}", "{Y}-{m}",
    "{m}/{Y}", r"{B}\s+{Y}",
]

# Whole-text layouts, most detailed first.
WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,\s+)"
MOST_SPECIFIC = [
    "{Y}-{m}-{d}[T ]{H}:{M}:{S}Z?", "{Y}-{m}-{d}[T ]{H}:{M}",
    "{d}-{m}-{Y} {H}:{M}:{S}", "{m}/{d}/{Y} {H}:{M} ?{p}",
    WEEKDAY + r"{d}\s+{b}\s+{Y}\s+{H}:{M}:{S}\s+GMT",
    WEEKDAY + r"{B}\s+{d},\s+{Y}",
    "{Y}-{m}-{d}", "{d}-{m}-{Y}", "{m}/{d}/{Y}", "{Y}/{m}/{d}",
    r"{B}\s+{d},\s+{Y}", r"{b}\s+{d},\s+{Y}", "{d}-{b}-{Y}", r"{B}\s+{Y}",
    "{b}-{Y}", "{b}-{y}", "{Y}-{m}", "{m}/{Y}",
]

# Fixed value: two-digit years from here on belong to the 1900s.
CENTURY_PIVOT = 69


def layout_regex(layout: str, whole: bool = False) -> tuple[str, list[str]]:
    """The regular expression of a layout and its pieces in group order."""
    names: list[str] = []
    out, i = "", 0
    while i < len(layout):
        if layout[i] == "{" and layout[i + 2] == "}":
            names.append(layout[i + 1])
            out += PIECES[layout[i + 1]]
            i += 3
        else:
            out += layout[i]
            i += 1
    if whole:
        out = r"^\s*" + out + r"\s*$"
    return "(?i)" + out, names


def _month_number(name: Column) -> Column:
    months = MON.strip("()").split("|")
    return F.array_position(F.array(*[F.lit(m) for m in months]), F.lower(F.left(name, F.lit(3))))


def parse_layout(text: Column, layout: str, whole: bool = False) -> Column:
    """Timestamp read by one layout, null where it does not match."""
    regex, names = layout_regex(layout, whole)
    part = {n: F.regexp_extract(text, regex, i + 1) for i, n in enumerate(names)}

    def number(name: str) -> Column:
        return F.trim(part[name]).try_cast("int")

    if "Y" in part:
        year = number("Y")
    else:
        year = number("y") + F.when(number("y") >= CENTURY_PIVOT, 1900).otherwise(2000)
    month = number("m") if "m" in part else _month_number(part["b" if "b" in part else "B"]).cast("int")
    day = number("d") if "d" in part else F.lit(1)
    hour = number("H") if "H" in part else F.lit(0)
    if "p" in part:
        hour = F.when(hour.between(1, 12), hour % 12 + F.when(F.lower(part["p"]) == "pm", 12).otherwise(0))
    minute = number("M") if "M" in part else F.lit(0)
    second = part["S"].try_cast("decimal(8,6)") if "S" in part else F.lit(0).cast("decimal(8,6)")
    return F.when(
        text.rlike(regex), F.try_make_timestamp_ntz(year, month, day, hour, minute, second)
    )


def parse_dates(text: Column, mode: str = "most_specific") -> Column:
    """Text in one of many date layouts to ``timestamp_ntz``; null if none fits.

    ``first_match`` tries short layouts on any part of the text, so a time of
    day is lost and ``25-Nov-2021`` reads as November 2020. ``most_specific``
    needs the whole text to match and tries the most detailed layout first.
    """
    if mode == "first_match":
        return F.coalesce(*[parse_layout(text, f) for f in FIRST_MATCH])
    if mode == "most_specific":
        return F.coalesce(*[parse_layout(text, f, whole=True) for f in MOST_SPECIFIC])
    raise ValueError(f"unknown mode {mode!r}")


def unread_layouts(df: DataFrame, text: str, mode: str = "most_specific") -> DataFrame:
    """``shape, n, example``: what texts that no layout reads look like, and how many there are of each.

    A shape has 9 for each run of digits and ``a`` for each run of letters. Nulls are not counted;
    the example is the least text of its shape.
    """
    shape = F.regexp_replace(F.regexp_replace(text, "[0-9]+", "9"), r"\p{L}+", "a")
    return (
        df.where(F.col(text).isNotNull() & parse_dates(F.col(text), mode).isNull())
        .groupBy(shape.alias("shape"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(text).alias("example"))
    )


def parse_timestamp(text: Column, fmt: str | None = None, strict: bool = False) -> Column:
    """ISO text, or text in the given pattern, to ``timestamp_ntz``.

    Failures give null, or stop the job with ``strict=True``.
    """
    pattern = [F.lit(fmt)] if fmt else []
    if strict:
        return F.to_timestamp_ntz(text, *pattern)
    if fmt is None:
        return text.try_cast("timestamp_ntz")
    return F.try_to_timestamp(text, *pattern).cast("timestamp_ntz")


def day_and_hour(day: Column, hour: Column) -> Column:
    """Timestamp from a day column and an hour column; null if either is null."""
    return F.concat(day, F.lit(" "), hour).try_cast("timestamp_ntz")
