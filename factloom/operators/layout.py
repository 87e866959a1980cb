"""Layout: from positioned words to lines and logical pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import is_numeric
from ..functions.text import text_quality
from ..plans.dims import GUTTER_BINS, GUTTER_HIGH, GUTTER_LOW, LINE_TOLERANCE, SIGN_GAP

PAGE = ["doc", "page"]
HALF = [*PAGE, "half"]


def upright_words(words: DataFrame) -> DataFrame:
    """Upright words, unless fewer than half of a page's words are upright."""
    page = Window.partitionBy(*PAGE)
    few = F.sum(F.col("upright").cast("int")).over(page) * 2 < F.count(F.lit(1)).over(page)
    return words.withColumn("keep", F.col("upright") | few).where("keep").drop("keep")


def line_numbers(words: DataFrame, keys: list[str] = HALF, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """Adds line_no; a line ends where top moves by more than the tolerance from the word before (sessions by gap)."""
    order = Window.partitionBy(*keys).orderBy("top", "x0", "word_idx")
    gap = F.abs(F.col("top") - F.lag("top").over(order))
    flagged = words.withColumn("new", F.coalesce((gap > tolerance).cast("int"), F.lit(1)))
    return flagged.withColumn("line_no", F.sum("new").over(order)).drop("new")


def merge_minus(lined: DataFrame, keys: list[str] = HALF) -> DataFrame:
    """A detached unicode minus joins the number right of it, at the minus's place."""
    order = Window.partitionBy(*keys, "line_no").orderBy("x0", "word_idx")
    following = F.lead("text").over(order)
    joins = F.coalesce(F.col("text").isin("−", "–", "—") & is_numeric(following) & (F.lead("x0").over(order) - F.col("x1") <= SIGN_GAP), F.lit(False))
    out = lined.withColumns({"joins": joins, "following": following})
    out = out.withColumn("taken", F.coalesce(F.lag("joins").over(order), F.lit(False)))
    return out.where("NOT taken").withColumn("text", F.when(F.col("joins"), F.concat(F.lit("-"), "following")).otherwise(F.col("text"))).drop("joins", "following", "taken")


def lines(lined: DataFrame, keys: list[str] = HALF) -> DataFrame:
    """One row a line with its tokens in reading order."""
    return lined.groupBy(*keys, "line_no").agg(F.array_sort(F.collect_list(F.struct("x0", "word_idx", "text", "x1"))).alias("toks"))


def line_text(toks: Column) -> Column:
    return F.array_join(F.transform(toks, lambda t: t["text"]), " ")


def _covered(words: DataFrame, low: int = 0, high: int = GUTTER_BINS) -> Column:
    """The bins of [low, high) that a word covers."""
    place = lambda x: F.least(F.lit(GUTTER_BINS - 1), F.greatest(F.lit(0), F.floor(F.col(x) / F.col("page_width") * GUTTER_BINS))).cast("int")
    a, b = F.greatest(place("x0"), F.lit(low)), F.least(place("x1"), F.lit(high - 1))
    return F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def gutter_histogram(words: DataFrame) -> DataFrame:
    """Words that cover each of the bins over a page's width; bins without words are left out."""
    return words.select(*PAGE, F.explode(_covered(words)).alias("bin")).groupBy(*PAGE, "bin").agg(F.count(F.lit(1)).alias("n_words"))


def gutters(words: DataFrame) -> DataFrame:
    """Per page the bin nearest to the middle that hardly any word covers, and its x; nulls if there is none.

    A word counts for the bins of the middle that it covers (few do any) and once for its page (bin -1), so counts are
    summed before they are shuffled and what remains of a page is one short list.
    """
    bins = F.explode(F.concat(F.array(F.lit(-1)), _covered(words, GUTTER_LOW, GUTTER_HIGH))).alias("bin")
    counts = words.select(*PAGE, "page_width", bins).groupBy(*PAGE, "bin").agg(F.count(F.lit(1)).alias("n"), F.max("page_width").alias("page_width"))
    pages = counts.groupBy(*PAGE).agg(F.max(F.when(F.col("bin") < 0, F.col("n"))).alias("words"), F.max("page_width").alias("page_width"), F.collect_list(F.struct("bin", "n")).alias("bins"))
    taken = F.transform(F.filter("bins", lambda b: b["n"] > F.greatest(F.lit(1.0), F.col("words") * 0.01)), lambda b: b["bin"])
    free = F.array_except(F.sequence(F.lit(GUTTER_LOW), F.lit(GUTTER_HIGH - 1)), taken)
    best = F.array_min(F.transform(free, lambda b: F.struct(F.abs(b + 0.5 - GUTTER_BINS / 2).alias("off"), b.alias("bin"))))["bin"]
    return pages.select(*PAGE, best.alias("bin"), "page_width").select(*PAGE, "bin", ((F.col("bin") + 0.5) / GUTTER_BINS * F.col("page_width")).alias("gutter"))


def split_two_up(words: DataFrame) -> DataFrame:
    """Adds half (0, or 1 right of the gutter) where a landscape page passes all guards."""
    g = words.join(gutters(words), PAGE, "left")
    right = (F.col("x0") + F.col("x1")) / 2 > F.col("gutter")
    page = Window.partitionBy(*PAGE)
    n = F.count(F.lit(1)).over(page)
    count = lambda c: F.coalesce(F.sum(c.cast("int")).over(page), F.lit(0))
    alpha = F.col("text").rlike(r"\p{L}")
    n_left, n_right = count(~right), count(right)
    least, most = F.least(n_left, n_right), F.greatest(n_left, n_right)
    lettered = (count(~right & alpha) >= 0.3 * n_left) & (count(right & alpha) >= 0.3 * n_right)
    ok = (F.col("page_width") > F.col("page_height")) & (n >= 20) & F.col("gutter").isNotNull() & (least >= 0.2 * most) & (least > 0) & lettered
    return g.withColumn("half", F.when(ok & right, 1).otherwise(0)).drop("bin", "gutter")


def page_scan(words: DataFrame) -> DataFrame:
    """Per physical page width, height, landscape, text and its quality. Sides change places on pages whose `rotation` (if words has it) is 90 or 270."""
    turned = F.col("rotation").isin(90, 270) if "rotation" in words.columns else F.lit(False)
    side = lambda own, other: F.max(F.when(turned, F.col(other)).otherwise(F.col(own)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda w: w["text"]), " ")
    pages = words.groupBy(*PAGE).agg(side("page_width", "page_height").alias("width"), side("page_height", "page_width").alias("height"), text.alias("text"))
    return pages.select(*PAGE, "width", "height", (F.col("width") > F.col("height")).alias("landscape"), "text", text_quality(F.col("text")).alias("quality"))


def scan_lines(pages: DataFrame) -> DataFrame:
    """Pages (any keys, text) by their lines: n, kind, label, values.

    A line with a digit is a _table row if gaps of two spaces or more part it, else _text; others are a _heading. Blank
    lines are left out.
    """
    keys = [c for c in pages.columns if c != "text"]
    rows = pages.select(*keys, F.posexplode(F.split("text", "\n")).alias("n", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    parts = F.split("line", r"\s{2,}")
    table = F.col("line").rlike(r"\d") & (F.size(parts) >= 2)
    values = F.filter(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.trim(p)), lambda p: p != "")
    kind = F.when(table, "_table").when(F.col("line").rlike(r"\d"), "_text").otherwise("_heading")
    return rows.select(*keys, "n", kind.alias("kind"), F.when(table, F.trim(F.get(parts, F.lit(0)))).otherwise(F.col("line")).alias("label"), F.when(table, values).otherwise(F.array().cast("array<string>")).alias("values"))


def logical_pages(halved: DataFrame) -> DataFrame:
    """Per logical page its number in the document and its text (words in reading order, joined by spaces)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "text"))), lambda w: w["text"]), " ")
    pages = halved.groupBy(*HALF).agg(text.alias("text"))
    return pages.withColumn("logical_idx", F.row_number().over(Window.partitionBy("doc").orderBy("page", "half")) - 1)
