"""Raw rows to one extraction a metric."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import is_note_ref, is_page_ref, parse_number
from ..functions.similarity import sorted_tokens, token_sort_ratio, token_sort_ratio_udf
from ..functions.text import clean_label
from ..plans.dims import MATCH_SCORE, METRICS


def metric_table(spark: SparkSession) -> DataFrame:
    """metric, metric_ord, home, also, side."""
    return spark.createDataFrame([(m, n, home, also, side) for n, (m, home, also, side, _) in enumerate(METRICS)], "metric string, metric_ord int, home string, also array<string>, side string")


def synonyms(spark: SparkSession) -> DataFrame:
    """metric, metric_ord, synonym, syn_ord: distinct cleaned wordings, in alphabetical order within a metric."""
    rows = spark.createDataFrame([(m, n, s) for n, (m, _, _, _, syns) in enumerate(METRICS) for s in syns], "metric string, metric_ord int, raw string")
    rows = rows.select("metric", "metric_ord", clean_label(F.col("raw")).alias("synonym")).distinct()
    return rows.withColumn("syn_ord", F.row_number().over(Window.partitionBy("metric").orderBy("synonym")))


def statement_metrics(spark: SparkSession) -> DataFrame:
    """Code, metric, is_home: a statement's own metrics and those it also carries."""
    rows = [(home, m, True) for m, home, _, _, _ in METRICS] + [(c, m, False) for m, _, also, _, _ in METRICS for c in also]
    return spark.createDataFrame(rows, "code string, metric string, is_home boolean")


def best_synonym(cleaned: DataFrame, table: DataFrame, native: bool = False) -> DataFrame:
    """Per distinct cleaned label its best metric, score and synonym, after the vetoes of P21 and P22; no row if none.

    Only pairs whose lengths allow the threshold are scored (LCS is at most the shorter length). The synonym table is
    small and fixed, so it is broadcast; labels are made distinct first. First best wins: metric order, then synonym.
    """
    labels = cleaned.select("label").where(F.length("label") >= 3).distinct().withColumn("a", F.length(sorted_tokens(F.col("label"))))
    pairs = labels.join(F.broadcast(table.withColumn("b", F.length(sorted_tokens(F.col("synonym"))))), F.expr(f"200.0 * least(a, b) >= {MATCH_SCORE} * (a + b)"))
    ratio = token_sort_ratio(F.col("label"), F.col("synonym")) if native else token_sort_ratio_udf("label", "synonym")
    scored = pairs.withColumn("score", ratio).where(F.col("score") >= MATCH_SCORE)
    best = scored.groupBy("label").agg(F.max(F.struct("score", -F.col("metric_ord"), -F.col("syn_ord"), "metric", "synonym")).alias("b")).select("label", "b.metric", "b.score", "b.synonym")
    return best.where(~vetoed(F.col("label"), F.col("synonym")))


def vetoed(label: Column, synonym: Column) -> Column:
    """An "other ..." row that is no other, or before against after."""
    lt, st = F.split(label, " "), F.split(synonym, " ")
    way = F.array(F.lit("before"), F.lit("after"))
    turned = F.arrays_overlap(lt, way) & F.arrays_overlap(st, way) & (F.array_contains(lt, "before") != F.array_contains(st, "before"))
    return (label.startswith("other ") & ~synonym.contains("other")) | turned


def label_matches(items: DataFrame, table: DataFrame, native: bool = False) -> DataFrame:
    """items with the metrics their labels match: each part around " representing ", or the whole if no part matches."""
    tried = items.withColumn("clean", clean_label(F.col("label")))
    parts = F.split("clean", " representing ")
    tried = tried.withColumn("try", F.when(F.size(parts) > 1, F.concat(F.transform(parts, clean_label), F.array("clean"))).otherwise(F.array("clean")))
    tried = tried.select("*", F.posexplode("try").alias("part", "piece")).withColumn("whole", F.col("part") == F.size("try") - 1).drop("clean")
    hit = tried.join(best_synonym(tried.select(F.col("piece").alias("label")), table, native).withColumnRenamed("label", "piece"), "piece")
    own = [c for c in items.columns if c in ("doc", "basis", "code", "page", "half", "item_seq")]
    row = Window.partitionBy(*own)
    return hit.withColumn("by_part", F.max(~F.col("whole")).over(row)).where("NOT by_part OR NOT whole").drop("try", "part", "piece", "whole", "by_part")


def without_references(values: Column, numbers: Column, label: Column) -> Column:
    """The numbers (null where a value is none) without a leading note reference, and then without a page reference."""
    at = lambda x, k: F.get(x, F.lit(k))
    first = is_note_ref(at(values, 0), at(numbers, 1), label)
    second = (F.size(values) >= 3) & is_page_ref(at(values, 1), at(values, 2), at(numbers, 2))
    skip = F.when(F.size(values) == 0, 0).otherwise(first.cast("int") + (first & second).cast("int"))
    return F.filter(F.slice(numbers, skip + 1, F.size(numbers)), lambda v: v.isNotNull())


def normalize(items: DataFrame, native: bool = False) -> DataFrame:
    """O8 over items with doc, basis, code: the best extraction of each metric that the statement may carry.

    Filters follow the best match (a label's second best never counts); of equal scores the first row wins.
    """
    spark = items.sparkSession
    m = label_matches(items, synonyms(spark), native)
    m = m.join(F.broadcast(statement_metrics(spark)), ["code", "metric"]).join(F.broadcast(metric_table(spark).select("metric", F.col("side").alias("want"))), "metric")
    m = m.where("want is null or side is null or side = want")
    m = m.withColumn("parsed", F.transform("values", parse_number)).withColumn("numbers", without_references(F.col("values"), F.col("parsed"), F.col("label"))).where(F.size("numbers") > 0)
    order = Window.partitionBy("doc", "basis", "code", "metric").orderBy(F.desc("score"), "page", "half", "item_seq")
    best = m.withColumn("n", F.row_number().over(order)).where("n = 1")
    return best.select("doc", "basis", "code", "metric", "is_home", F.get("numbers", F.lit(0)).alias("value"), F.col("label").alias("raw_label"), "page", "score", F.slice("numbers", F.lit(2), F.size("numbers")).alias("extra_values"))


def prefer_home(extractions: DataFrame) -> DataFrame:
    """A metric found on a statement that only also carries it gives way to its own statement."""
    order = Window.partitionBy("doc", "basis", "metric").orderBy(F.desc("is_home"), "code")
    return extractions.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
