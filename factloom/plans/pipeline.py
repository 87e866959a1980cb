"""Words of many documents to verdicts, by DataFrame transformations over written stages."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import detect_periods, detect_unit, sheet_name
from ..operators import layout, lines, locate, normalize, prove, report
from .dims import SIGNATURES
from .storage import Workspace


def page_texts(parsed: DataFrame, halved: DataFrame, legacy_text: bool = False) -> DataFrame:
    """Logical pages with their text: real lines, or (legacy) all words of the page in one line."""
    pages = layout.logical_pages(halved)
    if legacy_text:
        return pages
    rows = F.array_sort(F.collect_list(F.struct("line_no", layout.line_text(F.col("toks")).alias("t"))))
    text = parsed.groupBy(*layout.HALF).agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("text"))
    return pages.drop("text").join(text, layout.HALF)


def chosen_items(items: DataFrame, places: DataFrame, pages: DataFrame) -> DataFrame:
    """Items of each statement's page (places: doc, code, page, basis), with the values of its basis.

    Of two halves those count that show one of the statement's cues, or both if none does. Places on pages that a
    document does not have give nothing. items: parse_rows() with the halves' `ranges`.
    """
    t = F.lower("text")
    cues = F.array(*[F.struct(F.lit(c).alias("code"), reduce(lambda a, b: a | b, [t.rlike(p) for p in s[1]]).alias("cue")) for c, s in SIGNATURES.items()])
    halves = pages.select(*layout.HALF, F.explode(cues).alias("c")).select(*layout.HALF, "c.*")
    page = Window.partitionBy("doc", "page", "code")
    halves = halves.withColumn("some", F.max("cue").over(page)).where("cue OR NOT some").drop("some", "cue")
    found = items.join(halves, layout.HALF).join(places.select("doc", "code", "page", "basis"), ["doc", "code", "page"])
    return found.withColumn("values", lines.values_of(lines.in_columns(F.col("nums"), F.col("ranges"), F.col("basis")))).drop("nums", "ranges")


def report_places(primary: DataFrame, alternate: DataFrame) -> DataFrame:
    """Doc, code, page, basis of both reports. A report's basis is that of its balance sheet, for all its statements:
    primary consolidated, standalone or else financials; the alternate's, or without one the basis that the primary is not
    (standalone beside financials)."""
    sheet = lambda df: df.groupBy("doc").agg(F.max(F.when((F.col("code") == "BS") & F.col("page").isNotNull(), F.col("basis"))).alias("of"))
    label = F.lower(sheet_name(F.coalesce("of", F.lit("unknown"))))
    first = sheet(primary).select("doc", label.alias("basis"))
    second = first.select("doc", F.when(F.col("basis") == "standalone", "consolidated").otherwise("standalone").alias("else")).join(sheet(alternate), "doc", "left").select("doc", F.coalesce("of", "else").alias("basis"))
    at = lambda df, names: df.where("page is not null").select("doc", "code", "page").join(names, "doc")
    return at(primary, first).unionByName(at(alternate, second))


def anchors(pages: DataFrame) -> DataFrame:
    """Per document the unit and the periods that its first pages name. Values are never rescaled by them."""
    u, p = F.col("u"), F.col("p")
    found = locate.text_sample(pages).select("doc", detect_unit(F.col("sample")).alias("u"), detect_periods(F.col("sample")).alias("p"))
    return found.select("doc", u["unit"].alias("unit"), u["currency"].alias("currency"), u["multiplier"].alias("multiplier"), p["current"].alias("current_period"), p["prior"].alias("prior_period"))


class Run(NamedTuple):
    """verdicts with their document's anchors; side_by_side of documents with both reports; close() removes the tables that they read."""

    verdicts: DataFrame
    side_by_side: DataFrame
    close: Callable[[], None]


def run_all(words: DataFrame, legacy_text: bool = False) -> Run:
    """The whole plan over the words of many documents; nothing is collected between stages.

    Every document with a word gets a primary report, whatever was found. What several later stages read is written to
    the shared folder, so that each page is parsed and scored once and every plan starts from a scan.
    """
    space = Workspace(words.sparkSession)
    halved = space.put(layout.split_two_up(layout.upright_words(words)), "halved")
    parsed = space.put(layout.lines(layout.merge_minus(layout.line_numbers(halved))), "parsed")
    pages = space.put(page_texts(parsed, halved, legacy_text), "pages")
    items = space.put(lines.parse_rows(parsed).join(lines.basis_ranges(parsed), layout.HALF, "left"), "items")
    sure = locate.verified_pages(pages, halved, items).withColumn("verified", F.lit(True))
    scored = space.put(locate.score_pages(locate.readable(pages)).join(sure, ["doc", "page"], "left").withColumn("verified", F.coalesce("verified", F.lit(False))), "scored")
    primary = space.put(locate.locate(scored, pages), "primary")
    places = space.put(report_places(primary, locate.locate_alternate(scored, primary, pages)), "places")
    chosen = space.put(chosen_items(items, places, pages), "chosen")
    found = space.put(normalize.prefer_home(normalize.normalize(chosen)), "found")
    obs = found.select("doc", "basis", "metric", "value", F.lit("geometric").alias("source"), "page", F.lit(1).cast("long").alias("seq"))
    others = pages.select("doc").distinct().join(places.select("doc"), "doc", "left_anti").withColumn("basis", F.lit("financials"))
    sheets = places.select("doc", "basis").unionByName(others).distinct()
    verdicts = space.put(prove.prove(obs, sheets=sheets).join(anchors(pages), "doc", "left"), "verdicts")
    both = verdicts.groupBy("doc").agg(F.min("basis").alias("a"), F.max("basis").alias("b")).where("a <> b").select("doc")
    return Run(verdicts, report.side_by_side(verdicts.join(both, "doc", "left_semi")), space.close)


def run(words: DataFrame, legacy_text: bool = False) -> DataFrame:
    """doc, basis, metric, status, value, sources, page, passed, failed, unit, currency, multiplier, current_period, prior_period.

    run_all() for callers that need the verdicts alone, which are what remains in the shared folder.
    """
    made = run_all(words, legacy_text)
    out = Workspace(words.sparkSession).put(made.verdicts, "verdicts")
    made.close()
    return out
