"""Text: label cleaning, page quality, units, periods, names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.dims import PERIOD, UNITS

# What may stand in a label's parentheses or after its slash without being part of its identity.
QUALIFIER = r"(?:loss(?:es)?|decrease|used in|in rupees|rs\.?|net of [^)]*|refer[^)]*|notes?\s*[\d., ]*|continued|face value[^)]*|[a-z](?:\s*\+\s*[a-z])*)"
# Replacements that make a label comparable, in order; $2 keeps what follows the qualifier.
CLEANING = [
    (rf"/\s*\(?({QUALIFIER})\)?([\s)]|$)", " $2"),
    (rf"\(\s*{QUALIFIER}\s*\)", " "),
    (r"^[\divxlc]+[.)]\s*", ""),
    (r"^\((?:[ivxlc]{1,4}|[a-z]|\d{1,2})\)\s*", ""),
    (r"^(?:consolidated|standalone)\s+", ""),
    (r"[^a-z()/'& -]", " "),
    (r"\s+", " "),
]
# A money figure; a year heading; the heading of a reference column; words that make a heading a summary.
FIGURE = r"\d[\d,]{4,}|\d[\d,]*\.\d{2}\b"
YEAR_TOKEN = r"^\(?(?:19|20)\d{2}\)?$"
REF_HEADER = r"(?i)^(?:notes?|schedule|sch|page|ref)\.?$"
SUMMARY = "condensed|summaris|summariz|abridged"
# How a text names its basis.
CONSOLIDATED, STANDALONE = r"consolidated|\bgroup\b", r"standalone|\bseparate\b"


def clean_label(label: Column) -> Column:
    """F2."""
    return F.trim(reduce(lambda t, step: F.regexp_replace(t, *step), CLEANING, F.lower(label)))


def section_name(label: Column) -> Column:
    """a heading in lower case without parentheticals and leading numbering."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(label), r"\([^)]*\)", " "), r"^[\divxlc]+[.)]\s*", ""))


def text_quality(text: Column) -> Column:
    """EMPTY under 50 characters, OK if over 0.3 of them are in runs of three letters or more, else SUSPECT."""
    letters = F.aggregate(F.regexp_extract_all(text, F.lit("[A-Za-z]{3,}"), 0), F.lit(0), lambda n, run: n + F.length(run))
    return F.when(F.length(F.trim(text)) < 50, "EMPTY").when(letters / F.greatest(F.length(text), F.lit(1)) > 0.3, "OK").otherwise("SUSPECT")


def figure_count(text: Column) -> Column:
    """P6."""
    return F.regexp_count(text, F.lit(FIGURE))


def distinct_years(text: Column) -> Column:
    """A17."""
    return F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(?:19|20)\d{2}\b"), 0)))


def detect_unit(text: Column) -> Column:
    """struct of unit, currency, multiplier, raw by the first wording in list order; Units, UNKNOWN, 1 if none."""
    t = F.lower(text)
    found = lambda unit, currency, times, raw: F.struct(F.lit(unit).alias("unit"), F.lit(currency).alias("currency"), F.lit(times).alias("multiplier"), raw.alias("raw"))
    cases = [F.when(t.rlike(p), found(u, c, m, F.regexp_extract(t, p, 0))) for p, u, c, m in UNITS]
    return F.coalesce(*cases, found("Units", "UNKNOWN", 1.0, F.lit("default")))


def detect_periods(text: Column) -> Column:
    """F8: struct of current, prior and all distinct periods in order; Current and Prior if there is none."""
    dates = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit("(?i)" + PERIOD), 1), lambda d: F.trim(d)))
    none = F.size(dates) == 0
    return F.struct(F.when(none, "Current").otherwise(F.get(dates, 0)).alias("current"), F.when(none, "Prior").otherwise(F.get(dates, 1)).alias("prior"), dates.alias("columns"))


def sheet_name(basis: Column) -> Column:
    """F14."""
    return F.when(basis == "consolidated", "Consolidated").when(basis == "standalone", "Standalone").otherwise("Financials")


def strip_controls(text: Column) -> Column:
    """K4."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def is_title_heading(text: Column) -> Column:
    """Five words at most, title case, no digit."""
    return (F.size(F.split(F.trim(text), r"\s+")) <= 5) & (text == F.initcap(text)) & ~text.rlike(r"\d")


def search(text: Column, pattern: str) -> Column:
    """A match, or one after all spaces are taken out of both."""
    return text.rlike(pattern) | F.replace(text, F.lit(" "), F.lit("")).rlike(pattern.replace(" ", ""))


def is_heading(line: Column, patterns: list[str]) -> Column:
    """The title starts after two words at most, or only appears once spaces are taken out."""
    def one(p: str) -> Column:
        before = F.regexp_extract(line, rf"^(.*?)(?:{p})", 1)
        few = F.size(F.filter(F.split(before, r"\s+"), lambda w: w != "")) <= 2
        return F.when(line.rlike(p), few).otherwise(F.replace(line, F.lit(" "), F.lit("")).rlike(p.replace(" ", "")))

    return reduce(lambda a, b: a | b, [one(p) for p in patterns])
