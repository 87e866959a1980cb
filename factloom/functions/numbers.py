"""Number tokens: parsing, kinds of token, tolerance and grading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.dims import FLOOR, NOTE_FACTOR, RELATIVE

NUMERIC = r"^[0-9,().%\-−–—]+$"
PLACEHOLDERS = ["-", "−", "–", "—"]


#: White space that may stand around a token, and what counts as a number once separators are gone (as read by float()).
BLANK = " \t\n\x0b\x0c\r\x85\xa0\u2007\u202f"
FLOAT = r"[+-]?(?:[0-9]+(?:_[0-9]+)*\.?(?:[0-9]+(?:_[0-9]+)*)?|\.[0-9]+(?:_[0-9]+)*)(?:[eE][+-]?[0-9]+(?:_[0-9]+)*)?"
#: The same after at most one minus, which is counted apart.
NUMBER = rf"^(?:-\s*)?({FLOAT})$"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def parse_number(tok: Column) -> Column:
    """a report's number token as a double; null where it is none.

    Marks (* # and daggers) after it go, and commas, percent signs and parentheses around it. A number in parentheses or
    with a leading minus (of any kind) is negative; both together are so once.
    """
    blank = F.lit(BLANK)
    t = F.translate(F.rtrim(F.btrim(tok, blank), F.lit("*#†")), "−–—", "---")
    bare = F.btrim(F.translate(F.btrim(t, F.lit("()")), ",%", ""), blank)
    number = F.translate(F.regexp_extract(bare, NUMBER, 1), "_", "").try_cast("double")
    return number * F.when(t.rlike(r"(?s)^\(.*\)$") | bare.startswith("-"), -1.0).otherwise(1.0)


def is_numeric(tok: Column) -> Column:
    """P4."""
    return tok.rlike(NUMERIC) & tok.rlike("[0-9]")


def is_placeholder(tok: Column) -> Column:
    """P5."""
    return tok.isin(PLACEHOLDERS)


def is_note_ref(tok: Column, following: Column, label: Column) -> Column:
    """Whether the first number of a row is a note reference; `following` is the next token's number or null."""
    t = F.trim(tok)
    jump = F.coalesce(F.abs(following) >= NOTE_FACTOR * t.try_cast("double"), F.lit(False))
    return F.when(F.coalesce(label, F.lit("")).rlike(r"\d[a-z()]*\s*$"), F.lit(False)).when(t.rlike(r"^\d{1,2}$"), F.lit(True)).when(t.rlike(r"^(\d{3}|\d{1,2}\.\d{1,2})$"), jump).otherwise(F.lit(False))


def is_page_ref(tok: Column, following: Column, number: Column) -> Column:
    """Whether the number after a note reference is a page reference; `following` is the next token, `number` its number."""
    return F.trim(tok).rlike(r"^\d{1,3}$") & F.coalesce(following, F.lit("")).rlike("[.,]") & number.isNotNull()


def within(a: Column, b: Column) -> Column:
    """P23."""
    return F.abs(a - b) <= F.greatest(F.lit(FLOOR), F.lit(RELATIVE) * F.greatest(F.abs(a), F.abs(b)))


def grade(extracted: Column, golden: Column) -> Column:
    """CORRECT, SIGN, SCALE, WRONG or (no value) MISSING."""
    ratio = F.try_divide(extracted, golden)
    power = F.log10(F.when(ratio > 0, ratio))
    return (
        F.when(extracted.isNull(), "MISSING")
        .when(golden == 0, F.when(F.abs(extracted) < 1e-9, "CORRECT").otherwise("WRONG"))
        .when(F.abs(ratio - 1) <= 0.01, "CORRECT")
        .when(F.abs(ratio + 1) <= 0.01, "SIGN")
        .when((F.abs(power - F.bround(power)) < 0.01) & (F.bround(power) != 0), "SCALE")
        .otherwise("WRONG")
    )
