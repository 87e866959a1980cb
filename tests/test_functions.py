import pytest
from pyspark.sql import functions as F

from factloom.functions import numbers as N
from factloom.functions import similarity as S
from factloom.functions import text as T


@pytest.mark.parametrize("text, unit", [("(Rs. in Crores)", ("Crores", "INR", 1e7, "rs. in crores")), ("(in Millions)", ("Millions", "UNKNOWN", 1e6, "in millions")), ("USD in thousands", ("Thousands", "USD", 1e3, "usd in thousands")), ("Amounts in ₹ lakhs", ("Lakhs", "INR", 1e5, "₹ lakhs")), ("in europe", ("Millions", "EUR", 1e6, "eur")), ("nothing here", ("Units", "UNKNOWN", 1.0, "default"))])
def test_units(spark, text, unit):
    assert tuple(one(spark, T.detect_unit(F.col("t")), t=text)) == unit


@pytest.mark.parametrize("text, current, prior", [("31 March 2025 and 31 March 2024", "31 March 2025", "31 March 2024"), ("as at 31 December 2025", "31 December 2025", None), ("FY25 against FY24", "FY25", "FY24"), ("March 31, 2025", "Current", "Prior"), ("1st Jan 2020, 1st Jan 2020, 2nd feb 2019", "1st Jan 2020", "2nd feb 2019")])
def test_periods(spark, text, current, prior):
    got = one(spark, T.detect_periods(F.col("t")), t=text)
    assert (got.current, got.prior) == (current, prior)


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "int", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)] if v is not None else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("out")).first().out


@pytest.mark.parametrize("tok, value", [("1,49,982", 149982.0), ("(1,234.5)", -1234.5), ("−112,858", -112858.0), ("8,207.65", 8207.65), ("1,234*", 1234.0), ("-", None), ("abc", None), ("5d", None), ("1_0", 10.0), ("(−5)", -5.0), ("(-5)*", -5.0), ("(1,234", 1234.0), ("1,234)", 1234.0), ("1 234", None), ("((7))", -7.0), ("(5)%", None), ("- 5", -5.0), ("--5", 5.0), ("+5", 5.0), ("12%", 12.0), ("", None), (None, None), ("1.2.3", None)])
def test_parse_number(spark, tok, value):
    assert one(spark, N.parse_number(F.col("t")), t=tok) == value


@pytest.mark.parametrize("label, cleaned", [("Profit/(Loss) before tax", "profit before tax"), ("1. Revenue", "revenue"), ("(ii) Trade Receivables", "trade receivables"), ("Consolidated Net Profit", "net profit"), ("Assets (non-current)", "assets (non-current)")])
def test_clean_label(spark, label, cleaned):
    assert one(spark, T.clean_label(F.col("t")), t=label) == cleaned


@pytest.mark.parametrize("a, b, ok", [(100.0, 100.5, True), (100.0, 200.0, False), (1000.0, 1004.9, True)])
def test_tolerance(spark, a, b, ok):
    assert one(spark, N.within(F.col("a"), F.col("b")), a=a, b=b) is ok


@pytest.mark.parametrize("x, g, out", [(100.0, 100.5, "CORRECT"), (-100.0, 100.0, "SIGN"), (1e5, 100.0, "SCALE"), (150.0, 100.0, "WRONG"), (None, 100.0, "MISSING"), (0.0, 0.0, "CORRECT")])
def test_grade(spark, x, g, out):
    assert one(spark, N.grade(F.col("x").cast("double"), F.col("g")), x=x, g=g) == out


def test_similarity_forms_agree(spark):
    rows = [("total assets", "assets total"), ("net profit after tax", "profit for the year"), ("", ""), ("a", ""), ("cash and bank", "cash and bank balances")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select(S.token_sort_ratio(F.col("a"), F.col("b")).alias("x"), S.token_sort_ratio_udf("a", "b").alias("y")).collect()
    assert got[0].x == 100.0
    assert all(abs(r.x - r.y) < 1e-9 for r in got)


def test_headings(spark):
    pats = ["balance sheet"]
    assert one(spark, T.is_heading(F.col("t"), pats), t="acme group balance sheet at 31 march")
    assert one(spark, T.is_heading(F.col("t"), pats), t="bal ance sheet")
    assert not one(spark, T.is_heading(F.col("t"), pats), t="provisions are reviewed at each balance sheet date")


def test_units_and_periods(spark):
    assert one(spark, T.detect_unit(F.col("t"))["multiplier"], t="(Rs. in Crores)") == 1e7
    got = one(spark, T.detect_periods(F.col("t")), t="31 March 2025 and 31 March 2024")
    assert (got.current, got.prior) == ("31 March 2025", "31 March 2024")
