"""Reports: side by side, sheets, console order, scorecards, golden grading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import grade
from ..plans.dims import METRIC_NAMES, STATUSES

# Sheet colours of the statuses.
FILLS = {"VERIFIED": "C6EFCE", "PROBABLE": "FFEB9C", "FLAGGED": "FFC7CE", "MISSING": "D9D9D9", "DERIVED": "BDD7EE"}


#: What the rows of a side-by-side sheet compare.
BASES = ("consolidated", "standalone")


def _each_metric(df: DataFrame, *kept: str) -> DataFrame:
    """df with a row for each metric of the vocabulary, in order (metric_ord, metric)."""
    every = F.array(*[F.struct(F.lit(n).alias("metric_ord"), F.lit(m).alias("metric")) for n, m in enumerate(METRIC_NAMES)])
    return df.select(*kept, F.explode(every).alias("_each")).select(*kept, F.col("_each")["metric_ord"].alias("metric_ord"), F.col("_each")["metric"].alias("metric"))


def side_by_side(verdicts: DataFrame) -> DataFrame:
    """Per document and metric of the whole vocabulary both bases' values, statuses and pages, and the difference.

    A document's verdicts are folded into one array, so one exchange is all. Of verdicts that repeat a metric and basis
    the least by status, value and page counts.
    """
    rows = F.array_sort(F.collect_list(F.struct("metric", "basis", "status", "value", "page"))).alias("rows")
    docs = _each_metric(verdicts.groupBy("doc").agg(rows), "doc", "rows")
    pick = lambda b: F.get(F.filter("rows", lambda r: (r["metric"] == F.col("metric")) & (r["basis"] == b)), F.lit(0))
    out = docs.withColumns({b: pick(b) for b in BASES})
    sides = [c for b in BASES for c in (F.col(f"{b}.value").alias(f"{b}_value"), F.coalesce(f"{b}.status", F.lit("MISSING")).alias(f"{b}_status"), (F.col(f"{b}.page") + 1).alias(f"{b}_page"))]
    return out.select("doc", "metric_ord", "metric", *sides, (F.col("consolidated.value") - F.col("standalone.value")).alias("difference"))


def metric_sheet(verdicts: DataFrame) -> DataFrame:
    """K2, K5: a sheet row for every metric in order, with 1-based pages, joined lists and the status's fill. One exchange, none after prove()."""
    rows = F.array_sort(F.collect_list(F.struct("metric", "status", "value", "page", "sources", "passed", "failed"))).alias("rows")
    folded = verdicts.groupBy("doc", "basis").agg(rows).withColumn("names", F.transform("rows", lambda r: r["metric"]))  # once a document, not once a metric
    sheets = _each_metric(folded, "doc", "basis", "rows", "names")
    out = sheets.withColumn("_row", F.get("rows", F.array_position("names", F.col("metric")).cast("int") - 1)).withColumn("status", F.coalesce(F.col("_row")["status"], F.lit("MISSING")))
    fill = F.create_map(*[F.lit(x) for kv in FILLS.items() for x in kv])
    r = F.col("_row")
    return out.select("doc", "basis", "metric_ord", "metric", "status", r["value"].alias("value"), (r["page"] + 1).alias("page"), F.array_join(r["sources"], ", ").alias("sources"), F.array_join(r["passed"], "; ").alias("passed"), F.array_join(r["failed"], "; ").alias("failed"), fill[F.col("status")].alias("fill"))


def console_order(verdicts: DataFrame) -> DataFrame:
    """K6: verdicts with their place in the console report: FLAGGED, MISSING, DERIVED, VERIFIED, PROBABLE, then metric."""
    ord_of = F.create_map(*[x for n, s in enumerate(STATUSES) for x in (F.lit(s), F.lit(n))])
    return verdicts.selectExpr("*").withColumn("status_ord", ord_of[F.col("status")])


def scorecard(verdicts: DataFrame) -> DataFrame:
    """Counts by status a document, and of all (doc null): a rollup of the documents' counts, not of their verdicts."""
    docs = verdicts.groupBy("doc").agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES])
    return docs.rollup("doc").agg(*[F.coalesce(F.sum(s.lower()), F.lit(0)).alias(s.lower()) for s in STATUSES])


def primary(verdicts: DataFrame) -> DataFrame:
    """A document's primary report: consolidated where there is one, else financials, else standalone."""
    place = F.create_map(F.lit("consolidated"), F.lit(0), F.lit("financials"), F.lit(1), F.lit("standalone"), F.lit(2))[F.col("basis")]
    return verdicts.withColumn("first", F.min(place).over(Window.partitionBy("doc"))).where(place == F.col("first")).drop("first")


def graded(golden: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Golden values with the extracted ones and their grades."""
    return golden.join(verdicts.select("doc", "metric", "status", F.col("value").alias("extracted")), ["doc", "metric"], "left").withColumn("grade", grade(F.col("extracted"), F.col("golden")))


def golden_scorecard(grades: DataFrame) -> DataFrame:
    """Grades a document and of all, and how many VERIFIED values are not CORRECT."""
    kinds = ["CORRECT", "SCALE", "SIGN", "WRONG", "MISSING"]
    return grades.rollup("doc").agg(*[F.count_if(F.col("grade") == k).alias(k.lower()) for k in kinds], F.count_if((F.col("status") == "VERIFIED") & (F.col("grade") != "CORRECT")).alias("verified_wrong"))


def report_json(verdicts: DataFrame) -> DataFrame:
    """K7: one nested JSON object a document and basis."""
    entry = F.struct("status", "value", "sources", "page", "passed", "failed")
    return verdicts.groupBy("doc", "basis").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("metric"), entry))))).alias("report"))


def page_profile(pages: DataFrame) -> DataFrame:
    """Pages by text quality and the share of landscape pages."""
    return pages.groupBy("doc").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("quality") == "OK").alias("ok"), F.count_if(F.col("quality") == "SUSPECT").alias("suspect"), F.count_if(F.col("quality") == "EMPTY").alias("empty"), F.bround(F.avg(F.col("landscape").cast("int")), 2).alias("landscape"))


def _match_keys(items: DataFrame) -> DataFrame:
    return items.select(F.lower(F.trim("label")).alias("label"), F.transform("values", lambda v: F.lower(F.trim(v))).alias("values"))


def _accuracy(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """n_a, n_b, matched, accuracy: x's rows with an equal key in y, against the larger count; 0 where both are empty."""
    matched = x.join(y.select(*keys).distinct(), keys, "left_semi").agg(F.count(F.lit(1)).alias("matched"))
    sizes = x.agg(F.count(F.lit(1)).alias("n_a")).crossJoin(y.agg(F.count(F.lit(1)).alias("n_b"))).crossJoin(matched)  # three tables of one row
    return sizes.withColumn("accuracy", F.coalesce(F.try_divide(F.col("matched"), F.greatest("n_a", "n_b")), F.lit(0.0)))


def row_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many of a's rows have an equal row in b (label and values lower-case and trimmed), against the larger count."""
    return _accuracy(_match_keys(a), _match_keys(b), ["label", "values"])


def heading_match(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same for headings, by label alone."""
    keys = lambda df: df.select(F.lower(F.trim("label")).alias("label"))
    return _accuracy(keys(a), keys(b), ["label"])


def compare_scans(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two scans (kind, label, values) against each other: a row for tables (by label and values) and one for headings."""
    of = lambda df, kind: df.where(F.col("kind") == kind)
    tables, heads = row_match(of(a, "_table"), of(b, "_table")), heading_match(of(a, "_heading"), of(b, "_heading"))
    return tables.select(F.lit("_table").alias("kind"), "*").unionByName(heads.select(F.lit("_heading").alias("kind"), "*"))


def samples(rows: DataFrame, n: int, keys: list[str], order: list[str]) -> DataFrame:
    """The first n rows of each key, for a report."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= n)
