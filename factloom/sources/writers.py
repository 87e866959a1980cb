"""Sinks: sheets as partitioned files, comparison JSON (K1, K3, K8, K9)."""

from __future__ import annotations

import posixpath

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import sheet_name, strip_controls
from ..operators.report import metric_sheet

#: Characters of a sheet's name, at most.
NAME = 31


def default_output(source: str) -> str:
    """K8: where a run over `source` is written unless told otherwise: output/<name>_metrics."""
    return f"output/{posixpath.splitext(posixpath.basename(source.rstrip('/')))[0]}_metrics"


def _save(sheet: DataFrame, path: str, format: str) -> None:
    clean = [strip_controls(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in sheet.dtypes]
    sheet.select(*clean).write.mode("overwrite").partitionBy("doc", "sheet").format(format).save(path)


def write_sheets(verdicts: DataFrame, path: str, format: str = "parquet") -> None:
    """K1: a folder a document and sheet, one sheet a basis; text without control characters, sheet names of 31 characters at most."""
    _save(metric_sheet(verdicts).withColumn("sheet", F.substring(sheet_name(F.col("basis")), 1, NAME)), path, format)


def write_side_by_side(rows: DataFrame, path: str, format: str = "parquet") -> None:
    """K3: rows of report.side_by_side() as a sheet a document."""
    _save(rows.withColumn("sheet", F.lit("Side-by-Side")), path, format)


def write_workbooks(run, path: str, format: str = "parquet") -> None:
    """All sheets of a plans.pipeline.Run: path/metrics and, of documents with both reports, path/side_by_side."""
    write_sheets(run.verdicts, f"{path}/metrics", format)
    write_side_by_side(run.side_by_side, f"{path}/side_by_side", format)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
