"""Relations of the engine derived from the driver's tables: the same portable SQL for Spark and for the oracle.

{orders} and the like stand for tables. Money is summed in integer cents and divided once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OBS = """
WITH o AS (SELECT o_custkey AS k, CAST(round(o_totalprice * 100) AS BIGINT) AS c, o_orderstatus AS s, substr(o_orderpriority, 1, 1) AS p FROM {orders}),
b AS (SELECT k, sum(c) AS ta,
  sum(CASE WHEN s = 'F' THEN c ELSE 0 END) AS ca, sum(CASE WHEN p IN ('1', '2') THEN c ELSE 0 END) AS te,
  sum(CASE WHEN p = '1' THEN c ELSE 0 END) AS p1, sum(CASE WHEN p = '2' THEN c ELSE 0 END) AS p2, sum(CASE WHEN p = '3' THEN c ELSE 0 END) AS p3,
  sum(CASE WHEN p = '4' THEN c ELSE 0 END) AS p4, sum(CASE WHEN p = '5' THEN c ELSE 0 END) AS p5 FROM o GROUP BY k),
l AS (SELECT l_suppkey AS k, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, l_returnflag AS f FROM {lineitem}),
q AS (SELECT k, sum(CASE WHEN f = 'N' THEN c ELSE 0 END) AS n, sum(CASE WHEN f = 'R' THEN c ELSE 0 END) AS r, sum(CASE WHEN f = 'A' THEN c ELSE 0 END) AS a FROM l GROUP BY k),
x AS (
  SELECT concat('c', CAST(k AS VARCHAR(20))) AS doc, metric, CASE metric
    WHEN 'total_assets' THEN CASE WHEN k % 7 = 0 THEN ta + CAST(floor(CAST(ta AS DOUBLE) / 20) AS BIGINT) WHEN k % 11 <> 0 THEN ta END
    WHEN 'current_assets' THEN CASE WHEN k % 5 <> 0 THEN ca END
    WHEN 'non_current_assets' THEN ta - ca
    WHEN 'total_equity' THEN te
    WHEN 'total_liabilities' THEN CASE WHEN k % 3 <> 0 THEN ta - te END
    WHEN 'cash_from_operations' THEN p1
    WHEN 'cash_from_investing' THEN -p2
    WHEN 'cash_from_financing' THEN CASE WHEN k % 13 <> 0 THEN p3 END
    WHEN 'fx_effect_on_cash' THEN CASE WHEN k % 3 <> 0 THEN p4 END
    WHEN 'net_change_in_cash' THEN p1 - p2 + p3 + CASE WHEN k % 2 = 0 THEN p4 ELSE 0 END
    WHEN 'closing_cash' THEN p5
    WHEN 'cash_and_equivalents' THEN CASE WHEN k % 4 = 0 THEN p5 + CAST(floor(CAST(p5 AS DOUBLE) / 10) AS BIGINT) ELSE p5 END
  END AS cents, 'geometric' AS source, k % 17 AS page, 1 AS seq
  FROM b CROSS JOIN (VALUES ('total_assets'), ('current_assets'), ('non_current_assets'), ('total_equity'), ('total_liabilities'), ('cash_from_operations'), ('cash_from_investing'), ('cash_from_financing'), ('fx_effect_on_cash'), ('net_change_in_cash'), ('closing_cash'), ('cash_and_equivalents')) AS m(metric)
  UNION ALL
  SELECT concat('s', CAST(k AS VARCHAR(20))) AS doc, metric, CASE metric
    WHEN 'revenue' THEN n WHEN 'other_income' THEN r
    WHEN 'total_income' THEN CASE WHEN k % 9 <> 0 THEN n + r END
    WHEN 'profit_before_tax' THEN a
    WHEN 'net_profit' THEN a - CAST(floor(CAST(a AS DOUBLE) / 4) AS BIGINT)
    WHEN 'tax_expense' THEN CASE WHEN k % 6 <> 0 THEN CASE WHEN k % 2 = 1 THEN -1 ELSE 1 END * CAST(floor(CAST(a AS DOUBLE) / 4) AS BIGINT) END
  END AS cents, 'geometric' AS source, k % 17 AS page, 1 AS seq
  FROM q CROSS JOIN (VALUES ('revenue'), ('other_income'), ('total_income'), ('profit_before_tax'), ('net_profit'), ('tax_expense')) AS m(metric))
SELECT doc, CASE WHEN doc LIKE '%4' THEN 'standalone' ELSE 'consolidated' END AS basis, metric, CAST(cents AS DOUBLE) / 100 AS value, source, CAST(page AS INT) AS page, CAST(seq AS BIGINT) AS seq
FROM x WHERE cents IS NOT NULL
"""

VOTES = """
SELECT concat(CAST(l_suppkey AS VARCHAR(20)), '-', CAST(CAST(l_quantity AS INT) AS VARCHAR(20))) AS doc, 'consolidated' AS basis,
  CASE WHEN l_linenumber % 2 = 0 THEN 'revenue' ELSE 'inventories' END AS metric,
  CASE WHEN l_linenumber = 7 THEN l_quantity * 150 ELSE l_quantity * 100 + l_linenumber END AS value,
  concat('x', CAST(l_linenumber AS VARCHAR(20))) AS source, CAST(l_partkey % 40 AS INT) AS page, l_orderkey * 10 + l_linenumber AS seq
FROM {lineitem}
"""

BASES = """
SELECT concat('n', CAST(c_nationkey AS VARCHAR(20))) AS doc, b.basis, m.metric,
  CAST(sum(CASE WHEN (b.basis = 'consolidated' OR c_mktsegment = 'BUILDING') AND (m.metric = 'revenue' OR o_orderstatus = 'F') THEN CAST(round(o_totalprice * 100) AS BIGINT) ELSE 0 END) AS DOUBLE) / 100 AS value,
  CASE WHEN c_nationkey % 3 = 0 THEN 'PROBABLE' ELSE 'VERIFIED' END AS status, CAST(c_nationkey AS INT) AS page
FROM {orders} JOIN {customer} ON o_custkey = c_custkey CROSS JOIN (VALUES ('consolidated'), ('standalone')) AS b(basis) CROSS JOIN (VALUES ('revenue'), ('net_profit')) AS m(metric)
WHERE NOT (b.basis = 'standalone' AND m.metric = 'net_profit' AND c_nationkey % 2 = 0)
GROUP BY c_nationkey, b.basis, m.metric
"""

TOKENS = """
SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber
    WHEN 1 THEN CAST(c AS VARCHAR(20))
    WHEN 2 THEN concat('(', CAST(c % 100000 AS VARCHAR(20)), ')')
    WHEN 3 THEN concat(CAST(c % 1000 AS VARCHAR(20)), ',', right(concat('000', CAST(c % 997 AS VARCHAR(20))), 3), '.5')
    WHEN 4 THEN concat('−', CAST(c % 9999 AS VARCHAR(20)))
    WHEN 5 THEN concat(CAST(c % 99999 AS VARCHAR(20)), '*')
    WHEN 6 THEN CASE WHEN c % 2 = 0 THEN '-' ELSE concat(CAST(c % 60 AS VARCHAR(20)), '.', CAST(c % 9 AS VARCHAR(20))) END
    ELSE CASE c % 5 WHEN 0 THEN 'abc' WHEN 1 THEN '5d' WHEN 2 THEN CAST(c % 100 AS VARCHAR(20)) WHEN 3 THEN CAST(100 + c % 900 AS VARCHAR(20)) ELSE concat('  ', CAST(c % 77 AS VARCHAR(20)), '% ') END
  END AS tok
FROM (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS c FROM {lineitem}) AS t
"""

LABELS = """
SELECT concat(w.pre, p_name, w.post) AS label FROM {part} CROSS JOIN (VALUES ('1. ', ''), ('(ii) Other ', ' (net)'), ('Consolidated ', '/(loss) for the year'), ('', ' (refer note 5)'), ('iv) ', ' (non-current) *')) AS w(pre, post)
UNION ALL SELECT v.label FROM (VALUES ('Revenue from operations'), ('Turnover'), ('Other current liabilities'), ('Total Assets'), ('TOTAL EQUITY AND LIABILITIES'), ('Profit/(Loss) before tax'), ('1. Trade Receivables'), ('Net profit after minority interest'), ('Net increase/(decrease) in cash & cash equivalents'), ('Consolidated net profit for the year'), ('Profit for the year, representing total comprehensive income for the year'), ('eq'), ('Equity'), ('Assets total'), ('Earnings per share (basic)')) AS v(label)
"""

GOLDEN = """
SELECT doc, metric, CASE WHEN g % 7 = 0 THEN value * 1000 WHEN g % 7 = 1 THEN -value WHEN g % 7 = 2 THEN value * 1.3 WHEN g % 7 = 3 THEN 0 ELSE value * 1.001 END AS golden
FROM (SELECT doc, metric, value, length(doc) + length(metric) + CAST(substr(doc, 2, 9) AS INT) AS g FROM ({obs}) AS o) AS t
"""


def _tables(sql: str, spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names if "{" + t + "}" in sql}


def _filled(sql: str) -> str:
    """Puts in the relations that others are made of."""
    for name, text in (("pages", PAGES), ("rows", ROWS), ("obs", OBS)):
        sql = sql.replace("({" + name + "})", f"({text})")
    return sql


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    sql = _filled(sql)
    return spark.sql(sql, **_tables(sql, spark, sf_dir))


def oracle(sql: str) -> str:
    """The text that DuckDB runs: tables by their own names."""
    sql = _filled(sql)
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        sql = sql.replace("{" + t + "}", t)
    return sql


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' words on synthetic landscape pages: ten words a line in two blocks, 400 a page, tops that wobble."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("concat('d', doc_id) AS doc", "posexplode(split(text, ' ')) AS (i, text)").selectExpr(
        "doc", "CAST(floor(i / 400) AS INT) AS page", "CAST(i % 400 AS INT) AS word_idx", "text",
        "50.0D * (i % 10) + CASE WHEN i % 10 >= 5 THEN 60 ELSE 0 END AS x0",
        "50.0D * (i % 10) + CASE WHEN i % 10 >= 5 THEN 60 ELSE 0 END + 4.0D * least(length(text), 12) AS x1",
        "12.0D * floor((i % 400) / 10) + 1.5D * (i % 3) AS top",
        "i % 10 <> 9 AS upright", "600.0D AS page_width", "400.0D AS page_height",
    )


WORDS_SQL = """
SELECT concat('d', CAST(doc_id AS VARCHAR)) AS doc, CAST(i // 400 AS INT) AS page, CAST(i % 400 AS INT) AS word_idx, text,
  CAST(50 * (i % 10) + CASE WHEN i % 10 >= 5 THEN 60 ELSE 0 END AS DOUBLE) AS x0,
  CAST(50 * (i % 10) + CASE WHEN i % 10 >= 5 THEN 60 ELSE 0 END + 4 * least(length(text), 12) AS DOUBLE) AS x1,
  CAST(12 * ((i % 400) // 10) AS DOUBLE) + CAST(1.5 AS DOUBLE) * (i % 3) AS top,
  i % 10 <> 9 AS upright, CAST(600 AS DOUBLE) AS page_width, CAST(400 AS DOUBLE) AS page_height
FROM (SELECT doc_id, unnest(parts) AS text, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(text, ' ') AS parts FROM documents WHERE text IS NOT NULL))
"""

PAGES = """
SELECT concat('c', CAST(o_custkey AS VARCHAR(20))) AS doc, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS page,
  CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS logical_idx,
  concat(t.title, chr(10), CASE WHEN k % 4 = 0 THEN 'Total Assets ' ELSE 'Total income ' END, a.n, ' ', a.n, chr(10), CASE WHEN k % 3 = 0 THEN 'Current liabilities ' ELSE 'Profit before tax ' END, a.n, chr(10),
    CASE WHEN k % 5 < 3 THEN 'cash from operating activities and investing activities ' ELSE 'reserves and surplus ' END, a.n, ' ', a.n, chr(10),
    CASE WHEN k % 7 < 5 THEN concat(a.n, ' ', a.n, ' ', a.n, '.25') ELSE '2019 2020 2021 2022 2023 2024 2025 1999 1998 1997' END, CASE WHEN k % 11 = 0 THEN ' Standalone and Consolidated' ELSE '' END) AS text,
  k % 2 = 0 AS verified
FROM (SELECT o_orderkey, o_custkey, o_orderkey + o_custkey AS k, CAST(100000 + CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR(20)) AS m FROM {orders}) AS o
JOIN (SELECT o_orderkey AS ok, concat(CAST(100000 + CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR(20)), '') AS n FROM {orders}) AS a ON a.ok = o.o_orderkey
JOIN (VALUES (0, 'Consolidated Balance Sheet'), (1, 'Standalone Balance Sheet'), (2, 'BAL ANCE SHEET of the Group'), (3, 'Statement of Profit and Loss'), (4, 'We refer to the balance sheet date and the income statement'), (5, 'Condensed Balance Sheet'), (6, 'Cash Flow Statement'), (7, 'Consolidated Income Statement'), (8, 'Notes')) AS t(id, title) ON t.id = o.k % 9
"""


def statement_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all statement pages (PAGES) as a page reader places them: a line of the text every 14 points, 5 points a letter."""
    lines = relation(spark, sf_dir, PAGES).selectExpr("doc", "page", "posexplode(split(text, '\n')) AS (n, line)")
    return lines.selectExpr("doc", "page", "n", "split(line, ' ') AS words").selectExpr("doc", "page", "n", "words", "posexplode(words) AS (k, text)").where("text <> ''").selectExpr(
        "doc", "page", "600.0D AS page_width", "800.0D AS page_height", "n * 1000 + k AS word_idx", "text",
        "20.0D + 5 * (k + length(array_join(slice(words, 1, k), ''))) AS x0",
        "20.0D + 5 * (k + length(array_join(slice(words, 1, k + 1), ''))) AS x1",
        "20.0D + 14 * n AS top", "true AS upright",
    )


SCANNED = "SELECT doc, page, replace(replace(text, ' 1', '  1'), ' 2', '  2') AS text FROM ({pages}) AS p"


ROWS = """
SELECT concat('o', CAST(l_orderkey AS VARCHAR(20))) AS doc, 0 AS page, 0 AS half, CAST(l_linenumber * 8 + w.i AS INT) AS word_idx,
  CASE w.i WHEN 0 THEN 'Item' WHEN 1 THEN concat('part', CAST(l_partkey % 7 AS VARCHAR(20))) WHEN 2 THEN CASE l_partkey % 3 WHEN 0 THEN '−' WHEN 1 THEN '12' ELSE 'x' END
    WHEN 3 THEN concat(CAST(l_partkey AS VARCHAR(20)), ',', '500') ELSE CASE l_partkey % 4 WHEN 0 THEN '1,234' WHEN 1 THEN '-' WHEN 2 THEN 'abc' ELSE '(77)' END END AS text,
  CAST(40 * w.i AS DOUBLE) AS x0, CAST(40 * w.i + CASE WHEN l_partkey % 2 = 0 THEN 38 ELSE 5 END AS DOUBLE) AS x1, CAST(12 * l_linenumber AS DOUBLE) + CASE WHEN w.i = 4 THEN 1 ELSE 0 END AS top
FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS l CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS w(i)
"""

#: Half pages of the line parser: text lines, rows with and without labels, closing and ordinary ones, by order and line number.
#: No word is a reference heading, so no value floor applies: its SQL has none (w11_value_floor covers it).
BLOCKS = """
SELECT concat('o', CAST(l_orderkey AS VARCHAR(20))) AS doc, 0 AS page, 0 AS half, CAST(l_linenumber * 8 + w.i AS INT) AS word_idx,
  CASE WHEN w.i = 0 THEN CASE k WHEN 0 THEN 'Stock' WHEN 1 THEN 'Total' WHEN 2 THEN 'total' WHEN 3 THEN 'Net' WHEN 4 THEN 'wrapped' WHEN 5 THEN 'Current' WHEN 6 THEN 'Non-current' WHEN 7 THEN 'Remarks' ELSE CAST(1000 + p AS VARCHAR(20)) END
    WHEN w.i = 1 THEN CASE k WHEN 2 THEN 'assets' WHEN 3 THEN 'sales' WHEN 4 THEN 'end' WHEN 5 THEN 'assets' WHEN 6 THEN 'liabilities' ELSE CAST(p AS VARCHAR(20)) END
    ELSE concat(CAST(p AS VARCHAR(20)), ',500') END AS text,
  CAST(40 * w.i AS DOUBLE) AS x0, CAST(40 * w.i + 30 AS DOUBLE) AS x1, CAST(12 * l_linenumber AS DOUBLE) AS top
FROM (SELECT l_orderkey, l_linenumber, max(l_partkey) AS p, max(l_partkey) % 11 AS k FROM {lineitem} GROUP BY l_orderkey, l_linenumber) AS l CROSS JOIN (VALUES (0), (1), (2)) AS w(i)
WHERE NOT (k IN (5, 6, 7) AND w.i = 2) AND NOT (k = 7 AND w.i = 1)
"""
#: Header rows above the rows of ROWS: reference headings, years and the names of bases, at places that vary with the order.
HEADED = """
SELECT doc, page, half, word_idx, text, x0, x1, top FROM ({rows}) AS below
UNION ALL
SELECT concat('o', CAST(o_orderkey AS VARCHAR(20))), 0, 0, CAST(-10 + w.i AS INT), CASE w.i WHEN 0 THEN CASE o_custkey % 3 WHEN 0 THEN 'Note' WHEN 1 THEN 'Schedule' ELSE 'Item' END WHEN 1 THEN '2025' WHEN 2 THEN '(2024)' WHEN 3 THEN CASE o_custkey % 2 WHEN 0 THEN 'Standalone' ELSE 'Separate' END ELSE CASE o_custkey % 5 WHEN 0 THEN 'Group' ELSE 'Consolidated' END END,
  CAST(CASE WHEN w.i < 3 THEN 40 * (w.i + o_custkey % 4) ELSE 60 * (w.i - 3) + o_custkey % 50 END AS DOUBLE), CAST(CASE WHEN w.i < 3 THEN 40 * (w.i + o_custkey % 4) + 20 ELSE 60 * (w.i - 3) + o_custkey % 50 + 50 END AS DOUBLE), CAST(CASE WHEN w.i < 3 THEN 1 ELSE 5 END AS DOUBLE)
FROM {orders} CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS w(i)
"""
#: Page specs like 3,5-9 by order.
SPECS = """
SELECT DISTINCT concat(CAST(o_custkey % 50 AS VARCHAR(20)), ',', CAST(o_orderkey % 40 AS VARCHAR(20)), '-', CAST(o_orderkey % 40 + o_custkey % 9 AS VARCHAR(20)), ',', CAST(o_custkey % 50 AS VARCHAR(20))) AS spec FROM {orders}
"""

STATEMENT_WORDS_SQL = f"""
SELECT doc, page, 0 AS half, CAST(n * 1000 + k AS INT) AS word_idx, text, CAST(20 + 5 * (k + length(array_to_string(words[1:k], ''))) AS DOUBLE) AS x0, CAST(20 + 5 * (k + length(array_to_string(words[1:k + 1], ''))) AS DOUBLE) AS x1, CAST(20 + 14 * n AS DOUBLE) AS top
FROM (SELECT doc, page, n, words, unnest(words) AS text, unnest(range(len(words))) AS k FROM (SELECT doc, page, n, string_split(line, ' ') AS words FROM (SELECT doc, page, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM (SELECT doc, page, string_split(text, chr(10)) AS ls FROM ({oracle(PAGES)})))))
WHERE text <> ''
"""
