"""Typing of stored and imported values: strict readers raise, lenient ones give a default."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from reclutark.functions.text import LETTER, strip


def _typed_or_raise(c: Column, target: str) -> Column:
    value = c.try_cast(target)
    message = F.concat(F.lit(f"not a valid {target}: "), F.coalesce(c.cast("string"), F.lit("NULL")))
    return value, message


def strict_date(c: Column) -> Column:
    """Date, NULL kept; text that is not a date raises."""
    value, message = _typed_or_raise(c, "date")
    return F.when(c.isNotNull() & value.isNull(), F.raise_error(message).cast("date")).otherwise(value)


def lenient_date(c: Column) -> Column:
    """Date; text of none of the shapes of :func:`import_date` gives NULL."""
    dated = F.typeof(c).isin("date", "timestamp", "timestamp_ntz")  # known before the query runs: one branch is left
    return F.when(dated, c.try_cast("date")).otherwise(import_date(c))


def strict_int(c: Column) -> Column:
    """Whole number; NULL or any other text raises."""
    value, message = _typed_or_raise(c, "bigint")
    return F.when(value.isNull(), F.raise_error(message).cast("bigint")).otherwise(value)


# Shapes of a number.  Text is tested before it is cast, so a bad cell costs no exception.
SHORT_NUMBER = r"^\s*[-+]?\d{1,18}(\.\d*)?\s*$"
PLAIN_NUMBER = r"^\s*[-+]?\d+(\.\d*)?\s*$"
ANY_NUMBER = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def import_int(c: Column) -> Column:
    """Whole number of an imported cell, with or without exponent; a fraction is cut off.  Blank or other text, and what no
    BIGINT holds, gives NULL."""
    plain = F.substring_index(c, ".", 1).try_cast("bigint")
    other = F.when(c.rlike(ANY_NUMBER), c.try_cast("decimal(38,10)").try_cast("bigint"))
    return F.when(c.rlike(PLAIN_NUMBER), plain).otherwise(other)


def is_bad_number(c: Column) -> Column:
    """True for a cell that holds something, but no whole number."""
    # Numbers that surely fit are told by their shape alone, so most cells are not cast a second time.
    return F.coalesce(c.rlike(LETTER) & ~c.rlike(SHORT_NUMBER) & import_int(c).isNull(), F.lit(False))


def lenient_int(c: Column) -> Column:
    """Whole number of a text; NULL or other text gives 0 and a fraction is cut off."""
    return F.coalesce(import_int(c.cast("string")), F.lit(0).cast("bigint"))


def int_or_zero(c: Column) -> Column:
    """Whole number of a stored number, 0 for NULL."""
    return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))


# Shapes of an imported date, numbers or an English month, with an optional time of day.
TIME = r"(?:[ T]+\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?(?: *[AaPp][Mm])?(?: *(?:Z|[-+]\d{2}:?\d{2}))?)?$"
MONTH = (
    "(?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)"
    "(?:uary|ruary|ch|il|e|y|ust|t|tember|ober|ember)?)"
)
ISO_DAY = r"^\d{4}-\d{1,2}-\d{1,2}$"
YEAR_FIRST = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + TIME
YEAR_LAST = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + TIME
SHORT_YEAR = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})" + TIME
EIGHT_DIGITS = r"^(\d{4})(\d{2})(\d{2})(?:[ T]+\d{2}:?\d{2}(?::?\d{2}(?:\.\d+)?)?(?: *[AaPp][Mm])?(?: *(?:Z|[-+]\d{2}:?\d{2}))?)?$"
DAY_MONTH = r"^(\d{1,2})[-/. ]+" + MONTH + r"[-/., ]+(\d{4}|\d{2})" + TIME
MONTH_DAY = "^" + MONTH + r"[-/. ]+(\d{1,2})(?:,| ) *(\d{4})" + TIME
# Shapes without a day, or with an English month after the year, and how they are written in a shape from above.
REWRITTEN = (
    (r"^(\d{4})[-/.](\d{1,2})" + TIME, "$1-$2-1"),
    (r"^(\d{1,2})[-/](\d{4})" + TIME, "$2-$1-1"),
    ("^" + MONTH + r"[-/., ]+(\d{4})" + TIME, "$1 1 $2"),
    (r"^(\d{4})[-/. ]+" + MONTH + TIME, "$2 1 $1"),
    (r"^(\d{4})[-/. ]+" + MONTH + r"[-/. ]+(\d{1,2})" + TIME, "$2 $3 $1"),
)
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
# What all shapes begin with: a number or month that is parted from the next, or eight digits.
PARTED = r"^[0-9A-Za-z]++[-/., ]"
PARTED_OR_EIGHT = r"^(?:[0-9A-Za-z]++[-/., ]|\d{8})"


def import_dates(texts: Sequence[Column]) -> Column:
    """:func:`import_date` of texts without white space at their ends, as an array.

    Each step is worked out once for a text, as the next one is a function of its result; and the code of the shapes stands in no row's
    projection, which the JVM would not compile at that size.
    """
    return F.transform(F.transform(F.array(*texts), with_day), dated_text)


def import_date(c: Column) -> Column:
    """Date of an imported cell: year first, or month first, or day first when the first number is no month.

    Numbers are parted by hyphens, strokes or points, or eight digits in a row; an English month may stand before or after
    the day.  Without a day it is the first of the month.  Two digits of a year are 1969 to 2068.  Any other number (a spreadsheet serial) and any other text give NULL.
    The shape is tested before parsing and the casts are of the trying kind, so a bad cell costs no exception.
    """
    return dated_text(with_day(strip(c.cast("string"))))


def with_day(text: Column) -> Column:
    """Date text without white space at its ends, in a shape that has a day; any other text as it is."""
    written = text
    for shape, order in REWRITTEN:
        written = F.regexp_replace(written, shape, order)
    return F.when(text.rlike(ISO_DAY) | ~text.rlike(PARTED), text).otherwise(written)


def dated_text(text: Column) -> Column:
    """:func:`import_date` of what :func:`with_day` gives, which is worked out in a projection of its own where there are many dates."""

    def rewritten(shape: str, order: str) -> Column:
        return F.regexp_replace(text, shape, order).try_cast("date")

    def part(shape: str, group: int) -> Column:
        return F.regexp_extract(text, shape, group)

    def full(year: Column) -> Column:
        return F.when(F.length(year) == 4, year).when(year >= "69", F.concat(F.lit("19"), year)).otherwise(F.concat(F.lit("20"), year))

    def named(shape: str, year: int, month: int, of_month: int) -> Column:
        number = F.floor((F.instr(F.lit(MONTHS), F.lower(part(shape, month))) + 2) / 3).cast("string")
        return F.concat_ws("-", full(part(shape, year)), number, part(shape, of_month)).try_cast("date")

    century = F.when(part(SHORT_YEAR, 3) >= "69", F.lit("19")).otherwise(F.lit("20"))

    def shortened(order: str) -> Column:
        return F.concat(century, F.regexp_replace(text, SHORT_YEAR, order)).try_cast("date")

    return (
        F.when(text.rlike(ISO_DAY), text.try_cast("date"))
        .when(~text.rlike(PARTED_OR_EIGHT), F.lit(None).cast("date"))
        .when(text.rlike(YEAR_FIRST), rewritten(YEAR_FIRST, "$1-$2-$3"))
        .when(text.rlike(YEAR_LAST), F.coalesce(rewritten(YEAR_LAST, "$3-$1-$2"), rewritten(YEAR_LAST, "$3-$2-$1")))
        .when(text.rlike(EIGHT_DIGITS), rewritten(EIGHT_DIGITS, "$1-$2-$3"))
        .when(text.rlike(SHORT_YEAR), F.coalesce(shortened("$3-$1-$2"), shortened("$3-$2-$1")))
        .when(text.rlike(DAY_MONTH), named(DAY_MONTH, 3, 2, 1))
        .when(text.rlike(MONTH_DAY), named(MONTH_DAY, 3, 1, 2))
    )


def iso_text(c: Column) -> Column:
    """``YYYY-MM-DD`` text of a date, NULL kept."""
    return F.date_format(c, "yyyy-MM-dd")


def plausible_date(c: Column, first_year: int = 2000) -> Column:
    """The date, or NULL before ``first_year``."""
    return F.when(c >= F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), c)
