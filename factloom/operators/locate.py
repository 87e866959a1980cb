"""Locator: page scores and the choice of statement pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CONSOLIDATED, STANDALONE, SUMMARY, distinct_years, figure_count, is_heading, search, text_quality
from ..plans.dims import SIGNATURES


def _hits(text: Column, patterns: list[str], how=lambda t, p: t.rlike(p)) -> Column:
    return reduce(lambda a, b: a + b, [how(text, p).cast("int") for p in patterns])


def readable(pages: DataFrame) -> DataFrame:
    """Pages whose text is not EMPTY."""
    return pages.where(text_quality(F.col("text")) != "EMPTY")


def continues(pages: DataFrame, code: str, signatures=SIGNATURES) -> DataFrame:
    """Pages with `continues`: whether one may go on with a statement (a cue of it and 8 figures)."""
    t = F.lower("text")
    return pages.withColumn("continues", t.rlike("|".join(signatures[code][1])) & (figure_count(t) >= 8))


def beside(pages: DataFrame) -> DataFrame:
    """Logical pages with `same_page`: whether a neighbour in the document is a half of the same physical page."""
    order = Window.partitionBy("doc").orderBy("logical_idx")
    return pages.withColumn("same_page", F.lag("page").over(order).eqNullSafe(F.col("page")) | F.lead("page").over(order).eqNullSafe(F.col("page")))


def text_sample(pages: DataFrame, first: int = 15) -> DataFrame:
    """Per document the text of its first pages, in order; it names the unit and the periods."""
    texts = F.array_sort(F.collect_list(F.struct("page", "logical_idx", "text")))
    return pages.where(F.col("page") < first).groupBy("doc").agg(F.array_join(F.transform(texts, lambda p: p["text"]), " ").alias("sample"))


def score_pages(pages: DataFrame, signatures=SIGNATURES, head_lines: int = 6) -> DataFrame:
    """O3: pages (doc, logical_idx, text) times statements: score, basis, headed; 0 where disqualified.

    Signatures are folded into expressions, one array entry a statement, so pages are scanned once and nothing joins.
    """
    t = F.col("t")
    base = pages.select("doc", "page", "logical_idx", F.lower("text").alias("t"))
    base = base.withColumns({"figures": figure_count(t), "years": distinct_years(t), "heads": F.filter(F.transform(F.slice(F.split(F.trim(t), "\n"), 1, head_lines), lambda x: F.trim(x)), lambda x: x != "")})

    def found(code: str, titles: list[str], cues: list[str]) -> Column:
        line = F.get(F.filter("heads", lambda x: is_heading(x, titles)), F.lit(0))
        return F.struct(F.lit(code).alias("code"), _hits(t, titles, search).alias("title"), _hits(t, cues).alias("cues"), line.alias("line"))

    rows = F.explode(F.array(*[found(c, *s) for c, s in signatures.items()])).alias("s")
    rows = base.select("doc", "page", "logical_idx", "t", "figures", "years", rows).select("*", "s.*")  # what follows reads finished columns
    rows = rows.withColumn("line", F.when(~F.col("line").rlike(SUMMARY), F.col("line")))
    line, headed = F.col("line"), F.col("line").isNotNull()
    out = (F.col("title") == 0) | (F.col("cues") < 2) | (F.col("figures") < 8) | (F.col("years") >= F.when(headed, 10).otherwise(6))
    basis = (
        F.when(line.rlike(CONSOLIDATED), "consolidated")
        .when(line.rlike(STANDALONE), "standalone")
        .when(t.contains("consolidated"), "consolidated")
        .when(t.contains("standalone") | t.contains("separate financial"), "standalone")
        .otherwise("unknown")
    )
    score = 3.0 * F.col("title") + F.when(headed, 5).otherwise(0) + F.col("cues") + F.least("figures", F.lit(30)) * 0.1
    rows = rows.withColumn("out", out)
    return rows.select("doc", "page", "logical_idx", "code", F.when(F.col("out"), 0.0).otherwise(score).alias("score"), F.when(F.col("out"), "unknown").otherwise(basis).alias("basis"), (~F.col("out") & headed).alias("headed"))


def pick(scored: DataFrame, want: DataFrame | None = None, taken: DataFrame | None = None) -> DataFrame:
    """One page a document and statement.

    scored: score_pages() with `verified`. The headed tier is chosen first (it may then be emptied: nothing falls back),
    then taken pages go; with want (doc, code, basis) only that basis counts, else consolidated pages are preferred. The
    first verified candidate wins, else the best score; ties go to the earlier page.
    """
    best = Window.partitionBy("doc", "code").orderBy(F.desc("verified"), F.desc("score"), "logical_idx")
    return candidates(scored, want, taken).withColumn("n", F.row_number().over(best)).where("n = 1").select("doc", "code", "basis", "page", "logical_idx", "score")


def candidates(scored: DataFrame, want: DataFrame | None = None, taken: DataFrame | None = None) -> DataFrame:
    """The pages that pick() chooses from, with `place`: their order by score, earlier pages first among equals."""
    group = Window.partitionBy("doc", "code")
    pool = scored.where("score > 0").withColumn("tier", F.max("headed").over(group)).where("headed = tier")
    if taken is not None:
        pool = pool.join(taken, ["doc", "code", "logical_idx"], "left_anti")
    if want is not None:
        pool = pool.join(want, ["doc", "code", "basis"], "left_semi")
    else:
        pool = pool.withColumn("any", F.max(F.col("basis") == "consolidated").over(group)).where("NOT any OR basis = 'consolidated'").drop("any")
    return pool.withColumn("place", F.row_number().over(group.orderBy(F.desc("score"), "logical_idx")).cast("long"))


def locate(scored: DataFrame, docs: DataFrame | None = None, codes=tuple(SIGNATURES)) -> DataFrame:
    """The primary choice, with a row for each document (of docs, or of scored) and statement."""
    every = scored.select("doc", "code").distinct() if docs is None else docs.select("doc").distinct().select("doc", F.explode(F.array(*map(F.lit, codes))).alias("code"))
    return every.join(pick(scored), ["doc", "code"], "left").withColumns({"basis": F.coalesce("basis", F.lit("unknown")), "score": F.coalesce("score", F.lit(0.0))})


def locate_alternate(scored: DataFrame, primary: DataFrame, pages: DataFrame) -> DataFrame:
    """The other basis's page; if there is none, the primary page itself where its text names both bases."""
    other = F.when(F.col("basis") == "consolidated", "standalone").when(F.col("basis") == "standalone", "consolidated")
    wanted = primary.select("doc", "code", other.alias("basis"), F.col("page").alias("p_page"), F.col("logical_idx").alias("p_idx"), F.col("score").alias("p_score"))
    found = pick(scored, wanted.where("basis is not null").select("doc", "code", "basis"), wanted.where("p_idx is not null").select("doc", "code", F.col("p_idx").alias("logical_idx")))
    t = F.lower("text")
    both = pages.where((t.contains("standalone") | t.contains("separate")) & (t.contains("consolidated") | t.contains("group"))).select("doc", F.col("logical_idx").alias("p_idx"), F.lit(True).alias("both"))
    out = wanted.join(found.drop("basis"), ["doc", "code"], "left").join(both, ["doc", "p_idx"], "left")
    same = F.col("page").isNull() & F.col("both") & F.col("basis").isNotNull()
    use = lambda own, prim: F.when(same, F.col(prim)).otherwise(F.col(own)).alias(own)
    return out.select("doc", "code", F.coalesce("basis", F.lit("none")).alias("basis"), use("page", "p_page"), use("logical_idx", "p_idx"), F.coalesce(use("score", "p_score"), F.lit(0.0)).alias("score"))


def verified_pages(pages: DataFrame, lined: DataFrame, items: DataFrame) -> DataFrame:
    """Doc, page of pages with 8 figures, words in 2 columns (of 50 points) and 5 parsed rows at least."""
    figures = pages.groupBy("doc", "page").agg(F.sum(figure_count(F.lower("text"))).alias("figures")).where("figures >= 8")
    plain = F.translate("text", ".", "").rlike(r"^\d+$")
    columns = lined.where(plain).groupBy("doc", "page").agg(F.count_distinct(F.bround(F.col("x0") / 50) * 50).alias("columns")).where("columns >= 2")
    rows = items.groupBy("doc", "page").agg(F.count(F.lit(1)).alias("rows")).where("rows >= 5")
    return figures.join(columns, ["doc", "page"]).join(rows, ["doc", "page"]).select("doc", "page")
