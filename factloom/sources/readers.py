"""Sources: golden JSON, page specs, words of positioned text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "doc string, page int, page_width double, page_height double, word_idx int, text string, x0 double, x1 double, top double, upright boolean"


def read_words(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """The engine's entry relation, written by any page reader."""
    return spark.read.schema(WORDS).format(format).load(path)


def input_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """The documents of a folder. Their contents are not read; sort by path where the order matters."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")


def named(rows: DataFrame, part: str) -> DataFrame:
    """Rows whose doc holds `part` in whatever case; names that start with _ are no documents."""
    return rows.where(F.contains(F.lower("doc"), F.lit(part.lower())) & ~F.col("doc").startswith("_"))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Doc, unit, basis, metric, value, page of a JSON object of documents; keys that start with _ are left out."""
    kind = "map<string, struct<unit: string, basis: string, period: string, metrics: map<string, struct<value: double, page: int, label: string>>>>"
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kind)).alias("doc", "d")).where(~F.col("doc").startswith("_"))
    return docs.select("doc", "d.unit", "d.basis", F.explode("d.metrics").alias("metric", "m")).select("doc", "unit", "basis", "metric", F.col("m.value").alias("golden"), "m.page")


def page_spec(specs: DataFrame) -> DataFrame:
    """S7: "180,184-185" to one row a page; a range that runs backwards is empty."""
    part = specs.select("spec", F.explode(F.split("spec", ",")).alias("part"))
    ends = F.split("part", "-")
    low, high = F.trim(F.get(ends, F.lit(0))).cast("int"), F.trim(F.element_at(ends, -1)).cast("int")
    return part.select("spec", F.explode(F.when(high >= low, F.sequence(low, high))).alias("page")).distinct()
