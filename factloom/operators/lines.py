"""Lines to labelled number rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import is_numeric, is_placeholder, let
from ..functions.text import CONSOLIDATED, REF_HEADER, STANDALONE, YEAR_TOKEN, section_name
from ..plans.dims import MAX_VALUE_COLUMNS, MIN_SPREAD, REF_MARGIN
from .layout import HALF, line_text


def tail_start(toks: Column) -> Column:
    """How many tokens precede the longest run of numbers and placeholders at the end."""
    return F.coalesce(F.array_max(F.transform(toks, lambda t, i: F.when(is_numeric(t["text"]) | is_placeholder(t["text"]), 0).otherwise(i + 1))), F.lit(0))


def split_label(lines: DataFrame) -> DataFrame:
    """Adds label and nums; closing fragments of the label's open parentheses move back to it, one for each."""
    out = lines.withColumn("cut", tail_start(F.col("toks")))
    out = out.withColumns({"label": F.trim(line_text(F.slice("toks", F.lit(1), F.col("cut")))), "nums": F.slice("toks", F.col("cut") + 1, F.size("toks"))})
    count = lambda ch: F.length("label") - F.length(F.replace("label", F.lit(ch), F.lit("")))
    other = F.array_min(F.transform("nums", lambda t, i: F.when(~F.coalesce(t["text"].rlike(r"^[^()]*\)$"), F.lit(False)), i)))
    out = out.withColumn("back", F.greatest(F.lit(0), F.least(F.coalesce(other, F.size("nums")), count("(") - count(")"))))
    moved = F.transform(F.slice("nums", F.lit(1), F.col("back")), lambda t: t["text"])
    out = out.withColumns({"label": F.concat_ws(" ", "label", moved), "nums": F.slice("nums", F.col("back") + 1, F.size("nums"))})
    return out.drop("cut", "back")


def _headed(lines: DataFrame) -> DataFrame:
    """Adds what value_floors() asks of each line: years and the first one's x, ends of reference headings, first and last x."""
    years = F.filter("toks", lambda t: t["text"].rlike(YEAR_TOKEN))
    xs = F.transform("toks", lambda t: t["x0"])
    refs = F.transform(F.filter("toks", lambda t: t["text"].rlike(REF_HEADER)), lambda t: t["x1"])
    return lines.withColumns({"n_years": F.size(years), "at": F.array_min(F.transform(years, lambda t: t["x0"])), "refs": refs, "low": F.array_min(xs), "high": F.array_max(xs)})


def _floor(of) -> Column:
    """The floor of a half page, for of(aggregate) -> its value over the half page's lines of _headed()."""
    best = of(F.max(F.when(F.col("n_years") > 0, F.struct("n_years", "at"))))
    sure = (of(F.max("high")) - of(F.min("low")) >= MIN_SPREAD) & (best["n_years"] <= MAX_VALUE_COLUMNS)
    ref = let(best["at"], lambda at: F.array_max(F.filter(F.flatten(of(F.collect_list("refs"))), lambda x: x < at)))
    return F.when(sure, ref + REF_MARGIN)


def value_floors(lines: DataFrame) -> DataFrame:
    """Per half page the x left of which numbers are references, or null without a confident header."""
    return _headed(lines).groupBy(*HALF).agg(_floor(lambda a: a).alias("floor"))


def basis_ranges(lines: DataFrame) -> DataFrame:
    """Per half page the x ranges of basis columns declared in its first 12 lines; open ends.

    Neighbours part halfway between the left one's end, 150 points on, and the right one's start, yet never right of
    that start, so that numbers below a heading are its own where headings stand close.
    """
    declared = lines.where("line_no <= 12").where(F.lower(line_text(F.col("toks"))).rlike("standalone|consolidated|separate|group"))
    words = declared.select(*HALF, "line_no", F.explode("toks").alias("t")).withColumn("low", F.lower("t.text"))
    basis = F.when(F.col("low").rlike(STANDALONE), "standalone").when(F.col("low").rlike(CONSOLIDATED), "consolidated")
    found = words.withColumn("basis", basis).where("basis is not null").select(*HALF, "basis", F.col("t.x0").alias("x0"), (F.col("t.x1") + 150).alias("x1"), "line_no", F.col("t.word_idx").alias("word_idx"))
    order = Window.partitionBy(*HALF).orderBy("x0", "line_no", "word_idx")
    left, right = F.lag("x1").over(order), F.lead("x0").over(order)
    before = F.when(left.isNotNull(), F.least((left + F.col("x0")) / 2, F.col("x0")))
    after = F.when(right.isNotNull(), F.least((F.col("x1") + right) / 2, right))
    found = found.select(*HALF, "basis", F.coalesce(before, F.lit(0.0)).alias("x0"), F.coalesce(after, F.lit(9999.0)).alias("x1"))
    return found.groupBy(*HALF).agg(F.collect_list(F.struct("basis", "x0", "x1")).alias("ranges"))


def _unless_empty(kept: Column, whole: Column) -> Column:
    return F.when(F.size(kept) > 0, kept).otherwise(whole)


def in_columns(nums: Column, ranges: Column, basis: Column) -> Column:
    """The numbers in the columns that a page declares for a basis; all where it declares none, or none lies there."""
    mine = F.filter(ranges, lambda r: r["basis"] == basis)
    kept = F.filter(nums, lambda t: F.exists(mine, lambda r: (r["x0"] <= t["x0"]) & (t["x0"] <= r["x1"])))
    return F.when(F.coalesce(F.size(mine), F.lit(0)) > 0, _unless_empty(kept, nums)).otherwise(nums)


#: What the fold over a half page's lines carries: the text line just above, the last heading, the side it lies on, the
#: open block's heading, an unlabelled row that may be the block's subtotal, and the rows made.
_ROW = "struct<seq: bigint, label: string, nums: array<struct<x0: double, text: string>>, side: string>"
_STATE = f"struct<above: string, section: string, side: string, block: string, open: {_ROW}, made: array<{_ROW}>>"


def _read(state: Column, line: Column) -> Column:
    """The state after a line."""

    def after(above, section, side, block, open_, *made) -> Column:
        return F.struct(above.alias("above"), section.alias("section"), side.alias("side"), block.alias("block"), open_.alias("open"), F.concat(state["made"], *made).alias("made"))

    def row(label: Column) -> Column:
        return F.struct(line["seq"].alias("seq"), label.alias("label"), line["nums"].alias("nums"), state["side"].alias("side"))

    none, no_row = F.lit(None).cast("string"), F.lit(None).cast(_ROW)
    settled = F.when(state["open"].isNotNull(), F.array(state["open"])).otherwise(F.array().cast(f"array<{_ROW}>"))
    wrapped = F.when(line["label"].rlike(r"^\p{Ll}") & state["above"].isNotNull(), F.concat_ws(" ", state["above"], line["label"])).otherwise(line["label"])
    bare_total = lambda x: F.when(x.rlike("(?i)^(total|basic|diluted):?$") & (F.coalesce(state["section"], F.lit("")) != ""), F.concat_ws(" ", F.rtrim(x, F.lit(":")), state["section"])).otherwise(x)

    def item(label: Column) -> Column:
        closed = F.when(label.rlike(r"(?i)^(total|net)\b"), settled).otherwise(F.array().cast(f"array<{_ROW}>"))
        return after(none, state["section"], state["side"], F.when(~label.rlike(r"(?i)^total\b"), state["block"]), no_row, closed, F.array(row(label)))

    subtotal = after(none, state["section"], state["side"], state["block"], row(F.concat(F.lit("total "), state["block"])))
    heading = after(line["label"], line["section"], F.coalesce(line["side"], state["side"]), F.when(line["side"].isNotNull(), line["section"]).otherwise(state["block"]), no_row, settled)
    return F.when(line["kind"] == "item", let(wrapped, lambda w: let(bare_total(w), item))).when(line["kind"] == "text", heading).when(state["block"].isNotNull(), subtotal).otherwise(state).cast(_STATE)


def parse_rows(lines: DataFrame) -> DataFrame:
    """doc, page, half, item_seq, label, nums (x0, text), side: the rows that the line parser reads.

    A half page's lines are folded in order over one array, with the parser's carried state: a wrapped label takes the
    text line above it, bare totals take the last heading, sides carry on, and an unlabelled row within a block is its
    subtotal if a text line, a total or the end of the page comes next (of several the last; a labelled row drops it).
    """
    page = Window.partitionBy(*HALF)  # a window, as a join with value_floors() would work out the lines twice
    rows = _headed(split_label(lines)).drop("toks").withColumn("floor", _floor(lambda a: a.over(page)))
    rows = rows.where((F.col("label") != "") | (F.size("nums") > 0)).select(*HALF, "line_no", "label", "nums", "floor")
    right = F.filter("nums", lambda t: t["x0"] >= F.col("floor"))
    rows = rows.withColumn("nums", F.when(F.col("floor").isNotNull(), _unless_empty(right, F.col("nums"))).otherwise(F.col("nums")))
    has_label, has_nums = F.col("label") != "", F.size("nums") > 0
    rows = rows.withColumn("kind", F.when(has_label & has_nums, "item").when(has_nums, "bare").otherwise("text"))
    section = F.when(F.col("kind") == "text", section_name(F.col("label")))
    rows = rows.withColumn("section", section).withColumn("side", F.when(F.col("section").rlike("non[- ]current"), "non-current").when(F.col("section").contains("current"), "current"))
    nums = F.transform("nums", lambda t: F.struct(t["x0"].alias("x0"), t["text"].alias("text"))).alias("nums")
    halves = rows.groupBy(*HALF).agg(F.array_sort(F.collect_list(F.struct(F.col("line_no").cast("long").alias("seq"), "kind", "label", nums, "section", "side"))).alias("all"))
    start = F.from_json(F.lit('{"made": []}'), _STATE)
    end = F.aggregate("all", start, _read)
    made = F.concat(end["made"], F.when(end["open"].isNotNull(), F.array(end["open"])).otherwise(F.array().cast(f"array<{_ROW}>")))
    return halves.select(*HALF, F.explode(made).alias("r")).select(*HALF, F.col("r.seq").alias("item_seq"), "r.label", "r.nums", "r.side")


def values_of(nums: Column) -> Column:
    return F.transform(nums, lambda t: t["text"])


def raw_items(lines: DataFrame, want_basis: str | None = None) -> DataFrame:
    """parse_rows() with the values' texts, of the columns of want_basis where a page declares them."""
    rows, nums = parse_rows(lines), F.col("nums")
    if want_basis:
        rows = rows.join(basis_ranges(lines), HALF, "left")
        nums = in_columns(nums, F.col("ranges"), F.lit(want_basis))
    return rows.select(*HALF, "item_seq", "label", values_of(nums).alias("values"), "side")
