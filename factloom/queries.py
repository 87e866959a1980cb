"""Registered queries of the engine's own operators, each with DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from .functions import numbers as N
from .functions import similarity as S
from .functions import text as T
from .operators import layout, lines, locate, normalize, prove, report
from .plans import pipeline
from .sources import readers
from .plans.dims import DERIVATIONS, EXPECTED, IDENTITIES, METRIC_NAMES, METRICS, PERIOD, SIGN_AMBIGUOUS, SIGNATURES, TIES, UNITS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(_lit(v) if isinstance(v, str) else "NULL" if v is None else str(v) for v in r) + ")" for r in rows)


OBS, VOTES, BASES, TOKENS, LABELS, GOLDEN = map(A.oracle, (A.OBS, A.VOTES, A.BASES, A.TOKENS, A.LABELS, A.GOLDEN))
WITHIN = "abs({a} - {b}) <= greatest(2.0, 0.005 * greatest(abs({a}), abs({b})))"


def _within(a: str, b: str) -> str:
    return WITHIN.format(a=f"({a})", b=f"({b})")


# --- number tokens and texts -------------------------------------------------------------------------------------

PARSE = r"""
(SELECT CASE WHEN regexp_matches(t, '^\(.*\)$') OR starts_with(b, '-') THEN -v ELSE v END
 FROM (SELECT t, b, TRY_CAST(replace(CASE WHEN regexp_full_match(d, '[+-]?([0-9]+(_[0-9]+)*\.?([0-9]+(_[0-9]+)*)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+)?') THEN d END, '_', '') AS DOUBLE) AS v
 FROM (SELECT t, b, CASE WHEN starts_with(b, '-') THEN trim(substr(b, 2)) ELSE b END AS d
 FROM (SELECT t, trim(replace(replace(trim(t, '()'), ',', ''), '%', '')) AS b
 FROM (SELECT translate(rtrim(trim({tok}), '*#†'), '−–—', '---') AS t)))))"""
IS_NUMERIC = r"(regexp_matches({t}, '^[0-9,().%\-−–—]+$') AND regexp_matches({t}, '[0-9]'))"


@query("f1_parse_number", f"SELECT id, tok, {PARSE.format(tok='tok')} AS value FROM ({TOKENS})")
def f1(spark, sf):
    return A.relation(spark, sf, A.TOKENS).withColumn("value", N.parse_number(F.col("tok")))


@query("p4_numeric_token", f"SELECT id, {IS_NUMERIC.format(t='tok')} AS is_number, tok IN ('-', '−', '–', '—') AS is_nil FROM ({TOKENS})")
def p4(spark, sf):
    return A.relation(spark, sf, A.TOKENS).select("id", N.is_numeric(F.col("tok")).alias("is_number"), N.is_placeholder(F.col("tok")).alias("is_nil"))


PAIRS = f"SELECT id, tok, lead(tok) OVER (PARTITION BY id // 10 ORDER BY id, tok) AS nxt FROM ({TOKENS})"


def _pairs(spark, sf):
    return A.relation(spark, sf, A.TOKENS).selectExpr("id", "tok", "lead(tok) OVER (PARTITION BY id div 10 ORDER BY id, tok) AS nxt")


@query("p17_note_ref", rf"""
SELECT id, CASE WHEN regexp_matches(trim(tok), '^\d{{1,2}}$') THEN true
  WHEN regexp_matches(trim(tok), '^(\d{{3}}|\d{{1,2}}\.\d{{1,2}})$') THEN coalesce(abs({PARSE.format(tok='nxt')}) >= 100 * TRY_CAST(trim(tok) AS DOUBLE), false) ELSE false END AS note FROM ({PAIRS})""")
def p17(spark, sf):
    return _pairs(spark, sf).select("id", N.is_note_ref(F.col("tok"), N.parse_number(F.col("nxt")), F.lit("Inventories")).alias("note"))


@query("p18_page_ref", rf"""SELECT id, regexp_matches(trim(tok), '^\d{{1,3}}$') AND regexp_matches(trim(coalesce(nxt, '')), '[.,]') AND {PARSE.format(tok="coalesce(nxt, '')")} IS NOT NULL AS page_ref FROM ({PAIRS})""")
def p18(spark, sf):
    return _pairs(spark, sf).select("id", N.is_page_ref(F.col("tok"), F.col("nxt"), N.parse_number(F.col("nxt"))).alias("page_ref"))


@query("p23_tolerance", f"SELECT l_orderkey, l_linenumber, {_within('l_extendedprice', 'l_extendedprice * (1 + l_discount / 10)')} AS ok FROM lineitem")
def p23(spark, sf):
    a = F.col("l_extendedprice")
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", N.within(a, a * (1 + F.col("l_discount") / 10)).alias("ok"))


def _clean_sql(x: str) -> str:
    out = f"lower({x})"
    for pattern, to in T.CLEANING:
        out = f"regexp_replace({out}, {_lit(pattern)}, {_lit(to.replace('$', chr(92)))}, 'g')"
    return f"trim({out})"


@query("f2_clean_label", f"SELECT label, {_clean_sql('label')} AS cleaned FROM ({LABELS})")
def f2(spark, sf):
    return A.relation(spark, sf, A.LABELS).withColumn("cleaned", T.clean_label(F.col("label")))


@query("f6_section_name", rf"SELECT label, trim(regexp_replace(regexp_replace(lower(label), '\([^)]*\)', ' ', 'g'), '^[\divxlc]+[.)]\s*', '')) AS section FROM ({LABELS})")
def f6(spark, sf):
    return A.relation(spark, sf, A.LABELS).withColumn("section", T.section_name(F.col("label")))


DOCS = "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"


def _docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


@query("p1_text_quality", f"SELECT doc_id, CASE WHEN length(trim(text)) < 50 THEN 'EMPTY' WHEN length(array_to_string(regexp_extract_all(text, '[A-Za-z]{{3,}}'), '')) / greatest(length(text), 1) > 0.3 THEN 'OK' ELSE 'SUSPECT' END AS quality FROM {DOCS}")
def p1(spark, sf):
    return _docs(spark, sf).select("doc_id", T.text_quality(F.col("text")).alias("quality"))


@query("p6_figure_count", rf"SELECT doc_id, CAST(len(regexp_extract_all(text, '{T.FIGURE}')) AS INT) AS figures, CAST(len(list_distinct(regexp_extract_all(text, '\b(?:19|20)\d{{2}}\b'))) AS INT) AS years FROM {DOCS}")
def p6(spark, sf):
    return _docs(spark, sf).select("doc_id", T.figure_count(F.col("text")).alias("figures"), T.distinct_years(F.col("text")).alias("years"))


TEXTS = f"(SELECT doc_id AS id, text FROM {DOCS} UNION ALL SELECT -1 - page AS id, doc || ' ' || text AS text FROM ({A.oracle(A.PAGES)}))"


def _texts(spark, sf):
    return _docs(spark, sf).toDF("id", "text").unionByName(A.relation(spark, sf, A.PAGES).selectExpr("CAST(-1 - page AS BIGINT) AS id", "concat(doc, ' ', text) AS text"))


@query("f7_detect_unit", "SELECT id, md5(t) AS digest, " + ", ".join(
    "CASE " + " ".join(f"WHEN regexp_matches(lower(t), {_lit(u[0])}) THEN {_lit(u[k]) if isinstance(u[k], str) else f'CAST({u[k]} AS DOUBLE)'}" for u in UNITS) + f" ELSE {default} END AS {name}"
    for k, name, default in ((1, "unit", "'Units'"), (2, "currency", "'UNKNOWN'"), (3, "multiplier", "CAST(1 AS DOUBLE)"))) + f" FROM (SELECT id, text AS t FROM {TEXTS})")
def f7(spark, sf):
    return _texts(spark, sf).withColumn("u", T.detect_unit(F.col("text"))).select("id", F.md5("text").alias("digest"), "u.unit", "u.currency", "u.multiplier")


@query("f8_detect_periods", f"""
SELECT id, md5(t) AS digest, CASE WHEN len(d) = 0 THEN 'Current' ELSE d[1] END AS current, CASE WHEN len(d) = 0 THEN 'Prior' ELSE d[2] END AS prior
FROM (SELECT id, t, list_filter(a, lambda x, i: list_position(a, x) = i) AS d FROM (SELECT id, t, list_transform(regexp_extract_all(t, {_lit('(?i)' + PERIOD)}, 1), lambda x: trim(x)) AS a FROM (SELECT id, text AS t FROM {TEXTS})))""")
def f8(spark, sf):
    return _texts(spark, sf).withColumn("p", T.detect_periods(F.col("text"))).select("id", F.md5("text").alias("digest"), "p.current", "p.prior")


@query("k4_strip_controls", r"SELECT doc_id, md5(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS cleaned FROM " + DOCS)
def k4(spark, sf):
    return _docs(spark, sf).select("doc_id", F.md5(T.strip_controls(F.col("text"))).alias("cleaned"))


@query("f14_sheet_name", "SELECT doc, basis, CASE basis WHEN 'consolidated' THEN 'Consolidated' WHEN 'standalone' THEN 'Standalone' ELSE 'Financials' END AS sheet FROM (SELECT DISTINCT doc, basis FROM (" + OBS + "))")
def f14(spark, sf):
    return A.relation(spark, sf, A.OBS).select("doc", "basis").distinct().withColumn("sheet", T.sheet_name(F.col("basis")))


@query("s7_page_spec", f"SELECT DISTINCT spec, CAST(unnest(range(a, b + 1)) AS INT) AS page FROM (SELECT spec, CAST(split_part(part, '-', 1) AS INT) AS a, CAST(CASE WHEN contains(part, '-') THEN split_part(part, '-', 2) ELSE part END AS INT) AS b FROM (SELECT spec, unnest(string_split(spec, ',')) AS part FROM ({A.oracle(A.SPECS)}))) WHERE b >= a")
def s7(spark, sf):
    return readers.page_spec(A.relation(spark, sf, A.SPECS))


# --- similarity and matching -------------------------------------------------------------------------------------

SORTED = "array_to_string(list_sort(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')), ' ')"
SYNONYMS = "SELECT DISTINCT metric, metric_ord, " + _clean_sql("raw") + f" AS synonym FROM (VALUES {_values((m, n, s) for n, (m, _, _, _, syns) in enumerate(METRICS) for s in syns)}) AS v(metric, metric_ord, raw)"
#: Normalised Indel by a recursive table: row i of the LCS programme as a list, built from row i - 1.
LCS = """
scored AS (
  WITH RECURSIVE dp(label, synonym, x, y, i, r) AS (
    SELECT label, synonym, x, y, 0, list_transform(range(length(y) + 1), lambda k: 0) FROM pairs
    UNION ALL
    SELECT label, synonym, x, y, i + 1, list_reduce(range(1, length(y) + 1), lambda made, j: list_append(made, CASE WHEN substr(x, i + 1, 1) = substr(y, CAST(j AS INT), 1) THEN r[j] + 1 ELSE greatest(r[j + 1], made[len(made)]) END), [0]) FROM dp WHERE i < length(x))
  SELECT label, synonym, CAST(200 AS DOUBLE) * r[len(r)] / (length(x) + length(y)) AS score FROM dp WHERE i = length(x))"""


@query("f3_token_sort_ratio", f"""
WITH pairs AS (SELECT label, synonym, {SORTED.format(x='label')} AS x, {SORTED.format(x='synonym')} AS y FROM (SELECT DISTINCT {_clean_sql('label')} AS label FROM ({LABELS})) CROSS JOIN (SELECT DISTINCT synonym FROM ({SYNONYMS})) WHERE label <> ''), {LCS}
SELECT label, synonym, round(score, 6) AS score FROM scored""")
def f3(spark, sf):
    return _label_pairs(spark, sf).withColumn("score", F.round(S.token_sort_ratio_udf("label", "synonym"), 6))


def _label_pairs(spark, sf):
    """All distinct cleaned labels with the fixed table of some hundred synonyms."""
    labels = A.relation(spark, sf, A.LABELS).select(T.clean_label(F.col("label")).alias("label")).distinct().where("label <> ''")
    return labels.crossJoin(F.broadcast(normalize.synonyms(spark).select("synonym").distinct()))


VETO = "((starts_with(label, 'other ') AND NOT contains(synonym, 'other')) OR (len(list_intersect(string_split(label, ' '), ['before', 'after'])) > 0 AND len(list_intersect(string_split(synonym, ' '), ['before', 'after'])) > 0 AND list_contains(string_split(label, ' '), 'before') <> list_contains(string_split(synonym, ' '), 'before')))"
BEST = f"""
WITH syn AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY synonym) AS syn_ord FROM ({SYNONYMS})),
pairs AS (SELECT label, synonym, {SORTED.format(x='label')} AS x, {SORTED.format(x='synonym')} AS y FROM (SELECT DISTINCT {_clean_sql('label')} AS label FROM ({LABELS})) CROSS JOIN (SELECT DISTINCT synonym FROM syn)
  WHERE length(label) >= 3 AND 200 * least(length({SORTED.format(x='label')}), length({SORTED.format(x='synonym')})) >= 88 * (length({SORTED.format(x='label')}) + length({SORTED.format(x='synonym')}))), {LCS},
ranked AS (SELECT label, metric, score, synonym, row_number() OVER (PARTITION BY label ORDER BY score DESC, metric_ord, syn_ord) AS n FROM scored JOIN syn USING (synonym) WHERE score >= 88)
SELECT label, metric, round(score, 6) AS score, synonym FROM ranked WHERE n = 1 AND NOT {VETO}"""


@query("j2_best_synonym", BEST)
def j2(spark, sf):
    labels = A.relation(spark, sf, A.LABELS).select(T.clean_label(F.col("label")).alias("label"))
    return normalize.best_synonym(labels, normalize.synonyms(spark)).withColumn("score", F.round("score", 6))


@query("p21_p22_vetoes", f"SELECT label, synonym, {VETO} AS veto FROM (SELECT DISTINCT {_clean_sql('label')} AS label FROM ({LABELS})) CROSS JOIN (SELECT DISTINCT synonym FROM ({SYNONYMS})) WHERE label <> ''")
def p21(spark, sf):
    return _label_pairs(spark, sf).withColumn("veto", normalize.vetoed(F.col("label"), F.col("synonym")))


@query("u5_synonyms", f"SELECT metric, CAST(metric_ord AS INT) AS metric_ord, synonym, CAST(row_number() OVER (PARTITION BY metric ORDER BY synonym) AS INT) AS syn_ord FROM ({SYNONYMS})")
def u5(spark, sf):
    return normalize.synonyms(spark)


@query("u2_statement_metrics", f"SELECT * FROM (VALUES {_values([(home, m, True) for m, home, *_ in METRICS] + [(c, m, False) for m, _, also, *_ in METRICS for c in also])}) AS v(code, metric, is_home)")
def u2(spark, sf):
    return normalize.statement_metrics(spark)


# --- proofs ------------------------------------------------------------------------------------------------------

CONSENSUS = "SELECT doc, basis, metric, median(value) AS v, count(*) AS n, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM ({obs}) GROUP BY doc, basis, metric"


@query("a1_consensus_median", f"SELECT doc, metric, round(v, 4) AS value, n, sources FROM ({CONSENSUS.format(obs=VOTES)})")
def a1(spark, sf):
    c = prove.consensus(A.relation(spark, sf, A.VOTES))
    return c.select("doc", "metric", F.round("value", 4).alias("value"), "n", F.array_join("sources", ", ").alias("sources"))


@query("a2_voting", f"WITH o AS ({VOTES}), c AS ({CONSENSUS.format(obs=VOTES)}) SELECT doc, metric, bool_and({_within('o.value', 'c.v')}) AS vote FROM o JOIN c USING (doc, basis, metric) WHERE n > 1 GROUP BY doc, metric")
def a2(spark, sf):
    return prove.consensus(A.relation(spark, sf, A.VOTES)).where("n > 1").select("doc", "metric", "vote")


@query("a7_best_observation", f"WITH o AS ({VOTES}), c AS ({CONSENSUS.format(obs=VOTES)}) SELECT doc, metric, page FROM (SELECT doc, metric, page, row_number() OVER (PARTITION BY doc, metric ORDER BY abs(o.value - c.v), seq, page) AS k FROM o JOIN c USING (doc, basis, metric)) WHERE k = 1")
def a7(spark, sf):
    return prove.consensus(A.relation(spark, sf, A.VOTES)).select("doc", "metric", "page")


def _detail(name: str, a: str, b: str) -> str:
    return f"'{name} (' || format('{{{{:,.1f}}}}', {a}) || ' vs ' || format('{{{{:,.1f}}}}', {b}) || ')'"


def _checks_sql() -> str:
    """(doc, basis, ord, chk, detail, ok, metric) of all identities and ties, from wide rows w."""
    parts = []
    plus = " + ".join
    for n, (name, lhs, rhs, optional) in enumerate(IDENTITIES, 1):
        def ties(members, lhs=lhs):
            out = _within(plus(lhs), plus(members))
            for m in [m for m in members if m in SIGN_AMBIGUOUS]:
                out = f"({out} OR ({m} < 0 AND {_within(plus(lhs), plus(members) + f' - 2 * {m}')}))"
            return out

        there = " AND ".join(f"{m} IS NOT NULL" for m in lhs + rhs)
        wide = f"coalesce({ties(rhs + optional)}, false)" if optional else "false"
        ok = f"({wide} OR {ties(rhs)})"
        detail = _detail(name, plus(lhs), plus(rhs))
        parts += [f"SELECT doc, basis, {n} AS ord, '{name}' AS chk, {detail} AS detail, {ok} AS ok, '{m}' AS metric FROM w WHERE {there}" for m in lhs + rhs]
        parts += [f"SELECT doc, basis, {n}, '{name}', {detail}, {ok}, '{m}' FROM w WHERE {there} AND {m} IS NOT NULL AND ({wide} OR NOT {ok})" for m in optional]
    parts += [f"SELECT doc, basis, {n}, '{name}', {_detail(name, a, b)}, {_within(a, b)}, '{m}' FROM w WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for n, (name, a, b) in enumerate(TIES, 100) for m in (a, b)]
    return " UNION ALL ".join(parts)


WIDE = "SELECT doc, basis, " + ", ".join(f"max(v) FILTER (WHERE metric = '{m}') AS {m}" for m in METRIC_NAMES) + " FROM c GROUP BY doc, basis"
VERDICTS = f"""
WITH o AS ({{obs}}), c AS ({CONSENSUS.format(obs='SELECT * FROM o')}), w AS ({WIDE}), k AS ({_checks_sql()}
  UNION ALL SELECT doc, basis, 0, 'cross_extractor_voting', 'cross_extractor_voting', bool_and({_within('o.value', 'c.v')}), metric FROM o JOIN c USING (doc, basis, metric) WHERE n > 1 GROUP BY doc, basis, metric),
best AS (SELECT doc, basis, metric, arg_min(page, (abs(value - v), seq, page)) AS page FROM o JOIN c USING (doc, basis, metric) GROUP BY doc, basis, metric),
names AS (SELECT doc, basis, metric FROM c UNION SELECT doc, basis, metric FROM w CROSS JOIN (VALUES {_values((m,) for m in EXPECTED)}) AS e(metric)),
lists AS (SELECT doc, basis, metric, string_agg(detail, '; ' ORDER BY ord) FILTER (WHERE ok) AS passed, string_agg(detail, '; ' ORDER BY ord) FILTER (WHERE NOT ok) AS failed FROM k GROUP BY doc, basis, metric),
verdict AS (SELECT doc, basis, metric, CASE WHEN c.v IS NULL THEN 'MISSING' WHEN failed IS NOT NULL THEN 'FLAGGED' WHEN passed IS NOT NULL THEN 'VERIFIED' ELSE 'PROBABLE' END AS status,
  c.v AS value, coalesce(sources, '') AS sources, page, coalesce(passed, '') AS passed, coalesce(failed, '') AS failed
  FROM names LEFT JOIN c USING (doc, basis, metric) LEFT JOIN lists USING (doc, basis, metric) LEFT JOIN best USING (doc, basis, metric))"""


def _flat(df: DataFrame) -> DataFrame:
    lists = [F.array_join(c, sep).alias(c) for c, sep in (("sources", ", "), ("passed", "; "), ("failed", "; "))]
    return df.select("doc", "basis", "metric", "status", F.round("value", 4).alias("value"), "page", *lists)


FLAT = "SELECT doc, basis, metric, status, round(value, 4) AS value, page, sources, passed, failed FROM "


def _verdicts(spark, sf, adapter: str = A.OBS) -> DataFrame:
    return prove.validate(A.relation(spark, sf, adapter))


@query("o9_validate", VERDICTS.format(obs=OBS) + FLAT + "verdict")
def o9(spark, sf):
    return _flat(_verdicts(spark, sf))


@query("o9_validate_votes", VERDICTS.format(obs=VOTES) + FLAT + "verdict WHERE status <> 'MISSING'")
def o9v(spark, sf):
    return _flat(_verdicts(spark, sf, A.VOTES).where("status <> 'MISSING'"))


@query("o9_validate_status_counts", VERDICTS.format(obs=OBS) + "SELECT metric, status, count(*) AS n FROM verdict GROUP BY metric, status")
def o9c(spark, sf):
    return _verdicts(spark, sf).groupBy("metric", "status").agg(F.count(F.lit(1)).alias("n"))


def _check_query(name: str, chk: str):
    @query(name, VERDICTS.format(obs=OBS) + f"SELECT doc, basis, bool_and(ok) AS ok, count(*) AS n_metrics FROM k WHERE chk = '{chk}' GROUP BY doc, basis")
    def run(spark, sf):
        return prove.checked(A.relation(spark, sf, A.OBS), [chk]).drop("check")


for _name, _chk in (("a3_identity_sums", "balance_sheet_identity"), ("a4_sign_ambiguous", "net_profit_buildup"), ("a5_optional_fx", "cash_flow_total"), ("j6_cash_tie", "closing_cash_ties_to_balance_sheet"), ("j5_identity_terms", "assets_composition")):
    _check_query(_name, _chk)


@query("a9_status_rule", VERDICTS.format(obs=OBS) + "SELECT doc, basis, metric, status FROM verdict WHERE status <> 'MISSING'")
def a9(spark, sf):
    return _verdicts(spark, sf).where("status <> 'MISSING'").select("doc", "basis", "metric", "status")


@query("j8_missing_antijoin", VERDICTS.format(obs=OBS) + "SELECT doc, basis, metric FROM verdict WHERE status = 'MISSING'")
def j8(spark, sf):
    return _verdicts(spark, sf).where("status = 'MISSING'").select("doc", "basis", "metric")


def _derive_sql() -> str:
    m = [f"max({c}) FILTER (WHERE metric = '{x}') AS {c[0]}_{x}" for x in METRIC_NAMES for c in ("value", "status", "page")]
    rows = []
    for n, (target, formula) in enumerate(DERIVATIONS):
        trusted = " AND ".join(f"s_{x} IN ('VERIFIED', 'PROBABLE')" for x, _ in formula)
        unproven = " + ".join(f"CAST(s_{x} <> 'VERIFIED' AS INT)" for x, _ in formula)
        value = " ".join(f"{'+' if s > 0 else '-'} v_{x}" for x, s in formula)
        expr = " || ".join(_lit((("- " if s < 0 else "+ ") if k else "") + x + "[") + f" || substr(s_{x}, 1, 1) || ']'" + (" || ' '" if k < len(formula) - 1 else "") for k, (x, s) in enumerate(formula))
        rows.append(f"SELECT doc, basis, '{target}' AS metric, {n} AS ord, {unproven} AS unproven, {value} AS dv, p_{formula[0][0]} AS dp, {expr} AS expr FROM vw WHERE {trusted}")
    return f""", vw AS (SELECT doc, basis, {', '.join(m)} FROM verdict GROUP BY doc, basis),
cand AS ({' UNION ALL '.join(rows)}), pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc, basis, metric ORDER BY unproven, ord) AS k FROM cand) WHERE k = 1),
derived AS (SELECT doc, basis, metric, CASE WHEN good THEN 'DERIVED' ELSE status END AS status, CASE WHEN good THEN dv ELSE value END AS value, CASE WHEN good THEN 'derived' ELSE sources END AS sources,
  CASE WHEN good THEN dp ELSE page END AS page, CASE WHEN good THEN 'derived: ' || expr ELSE passed END AS passed,
  CASE WHEN status = 'MISSING' AND dv <= 0 THEN concat_ws('; ', nullif(failed, ''), 'derivation discarded (non-positive): ' || expr) ELSE failed END AS failed
  FROM (SELECT v.*, p.dv, p.dp, p.expr, coalesce(v.status = 'MISSING' AND p.dv > 0, false) AS good FROM verdict v LEFT JOIN pick p USING (doc, basis, metric)))"""


DERIVED = VERDICTS + _derive_sql().replace("{", "{{").replace("}", "}}")


@query("o10_derive", DERIVED.format(obs=OBS) + FLAT + "derived")
def o10(spark, sf):
    return _flat(prove.prove(A.relation(spark, sf, A.OBS)))


# --- reports -----------------------------------------------------------------------------------------------------


@query("a11_scorecard_rollup", DERIVED.format(obs=OBS) + "SELECT doc, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in ("FLAGGED", "MISSING", "DERIVED", "VERIFIED", "PROBABLE")) + " FROM derived GROUP BY ROLLUP (doc)")
def a11(spark, sf):
    return report.scorecard(prove.prove(A.relation(spark, sf, A.OBS)))


@query("a10_status_pivot", VERDICTS.format(obs=OBS) + "SELECT basis, " + ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s.lower()}" for s in ("VERIFIED", "PROBABLE", "FLAGGED", "MISSING")) + " FROM verdict GROUP BY basis")
def a10(spark, sf):
    names = ["VERIFIED", "PROBABLE", "FLAGGED", "MISSING"]
    wide = _verdicts(spark, sf).groupBy("basis").pivot("status", names).agg(F.count(F.lit(1)))
    return wide.select("basis", *[F.coalesce(n, F.lit(0)).alias(n.lower()) for n in names])


GRADE = "CASE WHEN extracted IS NULL THEN 'MISSING' WHEN golden = 0 THEN CASE WHEN abs(extracted) < 1e-9 THEN 'CORRECT' ELSE 'WRONG' END WHEN abs(extracted / golden - 1) <= 0.01 THEN 'CORRECT' WHEN abs(extracted / golden + 1) <= 0.01 THEN 'SIGN' WHEN extracted / golden > 0 AND abs(log10(extracted / golden) - round_even(log10(extracted / golden), 0)) < 0.01 AND round_even(log10(extracted / golden), 0) <> 0 THEN 'SCALE' ELSE 'WRONG' END"
GRADED = VERDICTS.format(obs=OBS) + f", graded AS (SELECT doc, metric, golden, extracted, status, {GRADE} AS grade FROM (SELECT g.doc, g.metric, CAST(g.golden AS DOUBLE) AS golden, v.value AS extracted, v.status FROM ({GOLDEN}) g LEFT JOIN verdict v ON g.doc = v.doc AND g.metric = v.metric))"


def _graded(spark, sf):
    return report.graded(A.relation(spark, sf, A.GOLDEN).withColumn("golden", F.col("golden").cast("double")), _verdicts(spark, sf))


@query("f9_grade", GRADED + "SELECT doc, metric, grade FROM graded")
def f9(spark, sf):
    return _graded(spark, sf).select("doc", "metric", "grade")


@query("j11_golden_join", GRADED + "SELECT doc, metric, round(extracted, 4) AS extracted, status, grade FROM graded")
def j11(spark, sf):
    return _graded(spark, sf).select("doc", "metric", F.round("extracted", 4).alias("extracted"), "status", "grade")


@query("a12_golden_scorecard", GRADED + "SELECT doc, " + ", ".join(f"count(*) FILTER (WHERE grade = '{g}') AS {g.lower()}" for g in ("CORRECT", "SCALE", "SIGN", "WRONG", "MISSING")) + ", count(*) FILTER (WHERE status = 'VERIFIED' AND grade <> 'CORRECT') AS verified_wrong FROM graded GROUP BY ROLLUP (doc)")
def a12(spark, sf):
    return report.golden_scorecard(_graded(spark, sf))


ORDERED = f"(VALUES {_values(enumerate(METRIC_NAMES))}) AS m(metric_ord, metric)"


@query("j9_side_by_side", f"""
WITH b AS ({BASES}), d AS (SELECT DISTINCT doc FROM b)
SELECT d.doc, CAST(m.metric_ord AS INT) AS metric_ord, m.metric, c.value AS consolidated_value, coalesce(c.status, 'MISSING') AS consolidated_status, c.page + 1 AS consolidated_page,
  s.value AS standalone_value, coalesce(s.status, 'MISSING') AS standalone_status, s.page + 1 AS standalone_page, round(c.value - s.value, 4) AS difference
FROM d CROSS JOIN {ORDERED} LEFT JOIN b c ON c.doc = d.doc AND c.metric = m.metric AND c.basis = 'consolidated' LEFT JOIN b s ON s.doc = d.doc AND s.metric = m.metric AND s.basis = 'standalone'""")
def j9(spark, sf):
    return report.side_by_side(A.relation(spark, sf, A.BASES)).withColumn("difference", F.round("difference", 4))


@query("k2_metric_sheet", DERIVED.format(obs=OBS) + f"""
SELECT s.doc, s.basis, CAST(m.metric_ord AS INT) AS metric_ord, m.metric, coalesce(v.status, 'MISSING') AS status, round(v.value, 4) AS value, v.page + 1 AS page, v.sources, v.passed, v.failed,
  CASE coalesce(v.status, 'MISSING') {' '.join(f"WHEN '{k}' THEN '{c}'" for k, c in report.FILLS.items())} END AS fill
FROM (SELECT DISTINCT doc, basis FROM derived) s CROSS JOIN {ORDERED} LEFT JOIN derived v ON v.doc = s.doc AND v.basis = s.basis AND v.metric = m.metric""")
def k2(spark, sf):
    return report.metric_sheet(prove.prove(A.relation(spark, sf, A.OBS))).withColumn("value", F.round("value", 4))


@query("k6_console_order", VERDICTS.format(obs=OBS) + "SELECT doc, metric, status, row_number() OVER (PARTITION BY doc, basis ORDER BY CASE status WHEN 'FLAGGED' THEN 0 WHEN 'MISSING' THEN 1 WHEN 'DERIVED' THEN 2 WHEN 'VERIFIED' THEN 3 ELSE 4 END, metric) AS place FROM verdict")
def k6(spark, sf):
    return report.console_order(_verdicts(spark, sf)).selectExpr("doc", "metric", "status", "CAST(row_number() OVER (PARTITION BY doc, basis ORDER BY status_ord, metric) AS BIGINT) AS place")


@query("k7_report_json", VERDICTS.format(obs=OBS) + FLAT + "verdict")
def k7(spark, sf):
    """The JSON reports, read back."""
    kind = "map<string, struct<status: string, value: double, sources: array<string>, page: int, passed: array<string>, failed: array<string>>>"
    back = report.report_json(_verdicts(spark, sf)).select("doc", "basis", F.explode(F.from_json("report", kind)).alias("metric", "r"))
    return _flat(back.select("doc", "basis", "metric", "r.*"))


@query("j15_row_match", f"WITH a AS (SELECT lower(trim(tok)) AS t FROM ({TOKENS}) WHERE id % 2 = 0), b AS (SELECT DISTINCT lower(trim(tok)) AS t FROM ({TOKENS}) WHERE id % 2 = 1), n AS (SELECT count(*) AS n_b FROM ({TOKENS}) WHERE id % 2 = 1) SELECT (SELECT count(*) FROM a) AS n_a, n_b, (SELECT count(*) FROM a WHERE t IN (SELECT t FROM b)) AS matched, (SELECT count(*) FROM a WHERE t IN (SELECT t FROM b)) / greatest((SELECT count(*) FROM a), n_b) AS accuracy FROM n")
def j15(spark, sf):
    rows = A.relation(spark, sf, A.TOKENS).select("id", F.lit("row").alias("label"), F.array("tok").alias("values"))
    return report.row_match(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))


def _heads(part: int) -> str:
    return f"SELECT lower(trim(split_part(text, chr(10), 1))) AS label FROM ({A.oracle(A.PAGES)}) WHERE page % 2 = {part}"


@query("j16_heading_match", f"WITH a AS ({_heads(0)}), b AS ({_heads(1)}), n AS (SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM a WHERE label IN (SELECT label FROM b)) AS matched) SELECT n_a, n_b, matched, matched / greatest(n_a, n_b) AS accuracy FROM n")
def j16(spark, sf):
    heads = A.relation(spark, sf, A.PAGES).select("page", F.substring_index("text", "\n", 1).alias("label"))
    return report.heading_match(heads.where("page % 2 = 0"), heads.where("page % 2 = 1"))


# --- layout ------------------------------------------------------------------------------------------------------

LINED = f"SELECT *, sum(new) OVER (PARTITION BY doc, page ORDER BY top, x0, word_idx) AS line_no FROM (SELECT *, CASE WHEN abs(top - lag(top) OVER (PARTITION BY doc, page ORDER BY top, x0, word_idx)) <= 2.5 THEN 0 ELSE 1 END AS new FROM ({A.WORDS_SQL}))"


@query("w1_line_groups", f"SELECT doc, page, line_no, count(*) AS n, min(word_idx) AS first_word, max(word_idx) AS last_word FROM ({LINED}) GROUP BY doc, page, line_no")
def w1(spark, sf):
    lined = layout.line_numbers(A.words(spark, sf), layout.PAGE)
    return lined.groupBy("doc", "page", "line_no").agg(F.count(F.lit(1)).alias("n"), F.min("word_idx").alias("first_word"), F.max("word_idx").alias("last_word"))


@query("w2_line_text", f"SELECT doc, page, line_no, string_agg(text, ' ' ORDER BY x0, word_idx) AS text FROM ({LINED}) GROUP BY doc, page, line_no")
def w2(spark, sf):
    lined = layout.lines(layout.line_numbers(A.words(spark, sf), layout.PAGE), layout.PAGE)
    return lined.select("doc", "page", "line_no", layout.line_text(F.col("toks")).alias("text"))


@query("p2_upright", f"SELECT doc, page, count(*) FILTER (WHERE upright OR keep) AS n FROM (SELECT *, sum(CAST(upright AS INT)) OVER (PARTITION BY doc, page) * 2 < count(*) OVER (PARTITION BY doc, page) AS keep FROM ({A.WORDS_SQL})) GROUP BY doc, page")
def p2(spark, sf):
    return layout.upright_words(A.words(spark, sf)).groupBy("doc", "page").agg(F.count(F.lit(1)).alias("n"))


HIST = f"SELECT doc, page, CAST(bin AS INT) AS bin, count(*) AS n_words FROM (SELECT doc, page, unnest(range(CAST(least(199, greatest(0, floor(x0 / page_width * 200))) AS INT), CAST(least(199, greatest(0, floor(x1 / page_width * 200))) AS INT) + 1)) AS bin FROM ({A.WORDS_SQL})) GROUP BY doc, page, bin"


@query("a14_gutter_histogram", HIST)
def a14(spark, sf):
    return layout.gutter_histogram(A.words(spark, sf))


GUTTER = f"""SELECT doc, page, arg_min(bin, (abs(bin + 0.5 - 100), bin)) FILTER (WHERE free) AS bin FROM (
  SELECT s.doc, s.page, b.bin, coalesce(h.n_words, 0) <= greatest(1, s.n * 0.01) AS free FROM (SELECT doc, page, count(*) AS n FROM ({A.WORDS_SQL}) GROUP BY doc, page) s CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(70, 130)) b LEFT JOIN ({HIST}) h ON h.doc = s.doc AND h.page = s.page AND h.bin = b.bin) GROUP BY doc, page"""


@query("t3_gutter_pick", f"SELECT doc, page, bin, (bin + 0.5) / 200 * CAST(600 AS DOUBLE) AS gutter FROM ({GUTTER})")
def t3(spark, sf):
    return layout.gutters(A.words(spark, sf))


@query("o2_two_up", f"""
WITH w AS ({A.WORDS_SQL}), g AS ({GUTTER}), h AS (SELECT w.*, coalesce((x0 + x1) / 2 > (bin + 0.5) / 200 * page_width, false) AS r, regexp_matches(text, '\\p{{L}}') AS alpha, bin FROM w LEFT JOIN g USING (doc, page)),
s AS (SELECT doc, page, count(*) AS n, max(bin) AS bin, count(*) FILTER (WHERE r) AS nr, count(*) FILTER (WHERE NOT r) AS nl, count(*) FILTER (WHERE r AND alpha) AS ar, count(*) FILTER (WHERE NOT r AND alpha) AS al FROM h GROUP BY doc, page),
k AS (SELECT doc, page, n >= 20 AND bin IS NOT NULL AND least(nl, nr) >= 0.2 * greatest(nl, nr) AND least(nl, nr) > 0 AND al >= 0.3 * nl AND ar >= 0.3 * nr AS ok FROM s)
SELECT doc, page, CAST(CASE WHEN ok AND r THEN 1 ELSE 0 END AS INT) AS half, count(*) AS n FROM h JOIN k USING (doc, page) GROUP BY ALL""")
def o2(spark, sf):
    return layout.split_two_up(A.words(spark, sf)).groupBy("doc", "page", "half").agg(F.count(F.lit(1)).alias("n"))


# --- lines -------------------------------------------------------------------------------------------------------

ROWS, PAGES = A.oracle(A.ROWS), A.oracle(A.PAGES)
ROW_LINED = f"SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY top, x0, word_idx) AS line_no FROM (SELECT *, CASE WHEN abs(top - lag(top) OVER (PARTITION BY doc ORDER BY top, x0, word_idx)) <= 2.5 THEN 0 ELSE 1 END AS new FROM ({ROWS}))"
MERGED = f"""SELECT doc, line_no, word_idx, x0, x1, CASE WHEN joins THEN '-' || nxt ELSE text END AS text FROM (
  SELECT *, coalesce(lag(joins) OVER (PARTITION BY doc, line_no ORDER BY x0, word_idx), false) AS taken FROM (
    SELECT *, coalesce(text IN ('−', '–', '—') AND {IS_NUMERIC.format(t='nxt')} AND nx - x1 <= 4.0, false) AS joins FROM (
      SELECT *, lead(text) OVER (PARTITION BY doc, line_no ORDER BY x0, word_idx) AS nxt, lead(x0) OVER (PARTITION BY doc, line_no ORDER BY x0, word_idx) AS nx FROM ({ROW_LINED})))) WHERE NOT taken"""


def _merged(spark, sf):
    return layout.merge_minus(layout.line_numbers(A.relation(spark, sf, A.ROWS)))


@query("w3_minus_merge", f"SELECT doc, line_no, word_idx, text, x0 FROM ({MERGED})")
def w3(spark, sf):
    return _merged(spark, sf).select("doc", "line_no", "word_idx", "text", "x0")


SPLIT = f"""SELECT doc, line_no, array_to_string(list_transform(toks[1:cut], lambda t: t.text), ' ') AS label, array_to_string(list_transform(toks[cut + 1:], lambda t: t.text), '|') AS nums
FROM (SELECT *, coalesce(list_max(list_transform(range(1, len(toks) + 1), lambda i: CASE WHEN {IS_NUMERIC.format(t='toks[i].text')} OR toks[i].text IN ('-', '−', '–', '—') THEN 0 ELSE i END)), 0) AS cut
FROM (SELECT doc, line_no, list(struct_pack(x0 := x0, text := text) ORDER BY x0, word_idx) AS toks FROM ({MERGED}) GROUP BY doc, line_no))"""


@query("w4_tail_split", SPLIT)
def w4(spark, sf):
    s = lines.split_label(layout.lines(_merged(spark, sf)))
    return s.select("doc", "line_no", "label", F.array_join(F.transform("nums", lambda t: t["text"]), "|").alias("nums"))


def _items_sql(words: str) -> str:
    """Rows of the line parser: lines in order, one step of a recursive table each, with the state carried in columns."""
    key = "doc, page, half"
    line = f"SELECT *, sum(new) OVER (PARTITION BY {key} ORDER BY top, x0, word_idx) AS line_no FROM (SELECT *, CASE WHEN abs(top - lag(top) OVER (PARTITION BY {key} ORDER BY top, x0, word_idx)) <= 2.5 THEN 0 ELSE 1 END AS new FROM ({words}))"
    return rf"""WITH RECURSIVE l AS (SELECT {key}, line_no, list(struct_pack(x0 := x0, text := text) ORDER BY x0, word_idx) AS toks FROM ({line}) GROUP BY ALL),
c AS (SELECT *, coalesce(list_max(list_transform(range(1, len(toks) + 1), lambda i: CASE WHEN {IS_NUMERIC.format(t='toks[i].text')} OR toks[i].text IN ('-', '−', '–', '—') THEN 0 ELSE i END)), 0) AS cut FROM l),
t AS (SELECT {key}, line_no, array_to_string(list_transform(toks[1:cut], lambda t: t.text), ' ') AS label, array_to_string(list_transform(toks[cut + 1:], lambda t: t.text), '|') AS nums FROM c),
k AS (SELECT *, CASE WHEN label <> '' AND nums <> '' THEN 'item' WHEN nums <> '' THEN 'bare' ELSE 'text' END AS kind, trim(regexp_replace(regexp_replace(lower(label), '\([^)]*\)', ' ', 'g'), '^[\divxlc]+[.)]\s*', '')) AS own,
  row_number() OVER (PARTITION BY {key} ORDER BY line_no) AS n FROM t),
o AS (SELECT *, CASE WHEN kind <> 'text' THEN NULL WHEN regexp_matches(own, 'non[- ]current') THEN 'non-current' WHEN contains(own, 'current') THEN 'current' END AS own_side FROM k),
st AS (
  SELECT DISTINCT {key}, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS above, CAST(NULL AS VARCHAR) AS section, CAST(NULL AS VARCHAR) AS side, CAST(NULL AS VARCHAR) AS block,
    CAST(NULL AS BIGINT) AS oseq, CAST(NULL AS VARCHAR) AS olabel, CAST(NULL AS VARCHAR) AS onums, CAST(NULL AS VARCHAR) AS oside,
    CAST(NULL AS BIGINT) AS fseq, CAST(NULL AS VARCHAR) AS flabel, CAST(NULL AS VARCHAR) AS fnums, CAST(NULL AS VARCHAR) AS fside,
    CAST(NULL AS BIGINT) AS eseq, CAST(NULL AS VARCHAR) AS elabel, CAST(NULL AS VARCHAR) AS enums, CAST(NULL AS VARCHAR) AS eside FROM o
  UNION ALL
  SELECT {key}, n, CASE WHEN kind = 'text' THEN label WHEN kind = 'bare' AND block IS NULL THEN above END, CASE WHEN kind = 'text' THEN own ELSE section END, coalesce(own_side, side),
    CASE WHEN own_side IS NOT NULL THEN own WHEN kind = 'item' AND regexp_matches(lab, '(?i)^total\b') THEN NULL ELSE block END,
    CASE WHEN kind = 'bare' AND block IS NOT NULL THEN line_no WHEN kind = 'bare' THEN oseq END, CASE WHEN kind = 'bare' AND block IS NOT NULL THEN 'total ' || block WHEN kind = 'bare' THEN olabel END,
    CASE WHEN kind = 'bare' AND block IS NOT NULL THEN nums WHEN kind = 'bare' THEN onums END, CASE WHEN kind = 'bare' AND block IS NOT NULL THEN side WHEN kind = 'bare' THEN oside END,
    CASE WHEN closes THEN oseq END, olabel, onums, oside, CASE WHEN kind = 'item' THEN line_no END, lab, nums, side
  FROM (SELECT *, kind = 'text' OR (kind = 'item' AND regexp_matches(lab, '(?i)^(total|net)\b')) AS closes FROM (
    SELECT *, CASE WHEN regexp_matches(first, '(?i)^(total|basic|diluted):?$') AND coalesce(section, '') <> '' THEN rtrim(first, ':') || ' ' || section ELSE first END AS lab FROM (
      SELECT st.* EXCLUDE (n), o.n, o.kind, o.label, o.nums, o.own, o.own_side, o.line_no, CASE WHEN o.kind = 'item' AND st.above IS NOT NULL AND regexp_matches(o.label, '^\p{{Ll}}') THEN st.above || ' ' || o.label ELSE o.label END AS first
      FROM st JOIN o ON o.doc = st.doc AND o.page = st.page AND o.half = st.half AND o.n = st.n + 1)))),
last AS (SELECT * FROM (SELECT *, max(n) OVER (PARTITION BY {key}) AS top FROM st) WHERE n = top)
SELECT {key}, CAST(seq AS BIGINT) AS item_seq, label, nums AS values, side FROM (
  SELECT {key}, eseq AS seq, elabel AS label, enums AS nums, eside AS side FROM st WHERE eseq IS NOT NULL
  UNION ALL SELECT {key}, fseq, flabel, fnums, fside FROM st WHERE fseq IS NOT NULL
  UNION ALL SELECT {key}, oseq, olabel, onums, oside FROM last WHERE oseq IS NOT NULL)"""


def _items(words: DataFrame) -> DataFrame:
    items = lines.raw_items(layout.lines(layout.merge_minus(layout.line_numbers(words))))
    return items.select("doc", "page", "half", "item_seq", "label", F.array_join("values", "|").alias("values"), "side")


@query("w9_raw_items", _items_sql(A.oracle(A.BLOCKS)))
def w9(spark, sf):
    return _items(A.relation(spark, sf, A.BLOCKS))


HEADED = A.oracle(A.HEADED)
HEAD_LINES = f"SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY top, x0, word_idx) AS line_no FROM (SELECT *, CASE WHEN abs(top - lag(top) OVER (PARTITION BY doc ORDER BY top, x0, word_idx)) <= 2.5 THEN 0 ELSE 1 END AS new FROM ({HEADED}))"


def _headed(spark, sf):
    return layout.lines(layout.line_numbers(A.relation(spark, sf, A.HEADED)))


@query("w11_value_floor", rf"""WITH w AS ({HEAD_LINES}), y AS (SELECT doc, line_no, count(*) AS n, min(x0) AS left_x FROM w WHERE regexp_matches(text, '{T.YEAR_TOKEN}') GROUP BY doc, line_no),
b AS (SELECT doc, arg_max(n, (n, left_x)) AS n, arg_max(left_x, (n, left_x)) AS left_x FROM y GROUP BY doc), s AS (SELECT doc, max(x0) - min(x0) AS spread FROM w GROUP BY doc)
SELECT s.doc, CASE WHEN spread >= 50 AND b.n <= 3 THEN (SELECT max(x1) + 12 FROM w WHERE w.doc = s.doc AND regexp_matches(w.text, '{T.REF_HEADER}') AND w.x1 < b.left_x) END AS floor FROM s LEFT JOIN b USING (doc)""")
def w11(spark, sf):
    return lines.value_floors(_headed(spark, sf)).select("doc", "floor")


@query("w12_basis_ranges", rf"""WITH w AS ({HEAD_LINES}), l AS (SELECT doc, line_no, string_agg(lower(text), ' ') AS t FROM w WHERE line_no <= 12 GROUP BY doc, line_no),
r AS (SELECT w.doc, line_no, word_idx, x0, x1 + 150 AS x1, CASE WHEN regexp_matches(lower(text), 'standalone|\bseparate\b') THEN 'standalone' WHEN regexp_matches(lower(text), 'consolidated|\bgroup\b') THEN 'consolidated' END AS basis
  FROM w JOIN l USING (doc, line_no) WHERE regexp_matches(t, 'standalone|consolidated|separate|group')),
n AS (SELECT *, lag(x1) OVER o AS px1, lead(x0) OVER o AS nx0 FROM r WHERE basis IS NOT NULL WINDOW o AS (PARTITION BY doc ORDER BY x0, line_no, word_idx))
SELECT doc, basis, CASE WHEN px1 IS NULL THEN 0 ELSE least((px1 + x0) / 2, x0) END AS x0, CASE WHEN nx0 IS NULL THEN 9999 ELSE least((x1 + nx0) / 2, nx0) END AS x1 FROM n""")
def w12(spark, sf):
    return lines.basis_ranges(_headed(spark, sf)).select("doc", F.explode("ranges").alias("r")).select("doc", "r.*")


# --- locator -----------------------------------------------------------------------------------------------------


def _score_sql() -> str:
    strip = lambda p: _lit(p.replace(" ", ""))
    parts = []
    for code, (titles, cues) in SIGNATURES.items():
        title = " + ".join(f"CAST(regexp_matches(t, {_lit(p)}) OR regexp_matches(replace(t, ' ', ''), {strip(p)}) AS INT)" for p in titles)
        cue = " + ".join(f"CAST(regexp_matches(t, {_lit(p)}) AS INT)" for p in cues)
        heads = " OR ".join(f"CASE WHEN regexp_matches(x, {_lit(p)}) THEN len(list_filter(string_split_regex(regexp_extract(x, {_lit('^(.*?)(?:' + p + ')')}, 1), '\\s+'), lambda w: w <> '')) <= 2 ELSE regexp_matches(replace(x, ' ', ''), {strip(p)}) END" for p in titles)
        parts.append(f"SELECT doc, page, logical_idx, verified, t, '{code}' AS code, {title} AS title, {cue} AS cues, list_filter(heads, lambda x: {heads})[1] AS first_line FROM p")
    return f"""WITH p AS (SELECT doc, page, logical_idx, verified, lower(text) AS t, list_filter(list_transform(string_split(trim(lower(text)), chr(10))[1:6], lambda x: trim(x)), lambda x: x <> '') AS heads FROM ({PAGES})),
s AS ({' UNION ALL '.join(parts)}),
h AS (SELECT *, CASE WHEN NOT regexp_matches(first_line, 'condensed|summaris|summariz|abridged') THEN first_line END AS line, len(regexp_extract_all(t, {_lit(T.FIGURE)})) AS figures, len(list_distinct(regexp_extract_all(t, {_lit(chr(92) + 'b(?:19|20)' + chr(92) + 'd{2}' + chr(92) + 'b')}))) AS years FROM s),
scored AS (SELECT doc, page, logical_idx, verified, t, code, CASE WHEN o THEN CAST(0 AS DOUBLE) ELSE CAST(3 * title + CASE WHEN line IS NOT NULL THEN 5 ELSE 0 END + cues AS DOUBLE) + least(figures, 30) * CAST(0.1 AS DOUBLE) END AS score,
  CASE WHEN o THEN 'unknown' WHEN regexp_matches(line, 'consolidated|\\bgroup\\b') THEN 'consolidated' WHEN regexp_matches(line, 'standalone|\\bseparate\\b') THEN 'standalone' WHEN contains(t, 'consolidated') THEN 'consolidated' WHEN contains(t, 'standalone') OR contains(t, 'separate financial') THEN 'standalone' ELSE 'unknown' END AS basis,
  NOT o AND line IS NOT NULL AS headed FROM (SELECT *, title = 0 OR cues < 2 OR figures < 8 OR years >= CASE WHEN line IS NOT NULL THEN 10 ELSE 6 END AS o FROM h)),
tier AS (SELECT * FROM (SELECT *, max(CAST(headed AS INT)) OVER (PARTITION BY doc, code) AS top FROM scored WHERE score > 0) WHERE CAST(headed AS INT) = top),
pool AS (SELECT * FROM (SELECT *, bool_or(basis = 'consolidated') OVER (PARTITION BY doc, code) AS any_c FROM tier) WHERE NOT any_c OR basis = 'consolidated'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc, code ORDER BY verified DESC, score DESC, logical_idx) AS n, row_number() OVER (PARTITION BY doc, code ORDER BY score DESC, logical_idx) AS by_score FROM pool),
prim AS (SELECT d.doc, d.code, coalesce(r.basis, 'unknown') AS basis, r.page, r.logical_idx, coalesce(r.score, 0) AS score FROM (SELECT DISTINCT doc, code FROM scored) d LEFT JOIN (SELECT * FROM ranked WHERE n = 1) r USING (doc, code)),
want AS (SELECT doc, code, CASE basis WHEN 'consolidated' THEN 'standalone' WHEN 'standalone' THEN 'consolidated' END AS w, page AS pp, logical_idx AS pi, score AS ps FROM prim),
alt AS (SELECT * FROM (SELECT t.*, row_number() OVER (PARTITION BY t.doc, t.code ORDER BY verified DESC, t.score DESC, t.logical_idx) AS n FROM tier t JOIN want ON t.doc = want.doc AND t.code = want.code AND t.basis = w AND t.logical_idx IS DISTINCT FROM pi) WHERE n = 1),
other AS (SELECT want.doc, want.code, coalesce(w, 'none') AS basis, coalesce(a.page, CASE WHEN same THEN pp END) AS page, coalesce(a.logical_idx, CASE WHEN same THEN pi END) AS logical_idx, coalesce(a.score, CASE WHEN same THEN ps END, 0) AS score
  FROM want LEFT JOIN alt a USING (doc, code) LEFT JOIN (SELECT doc, logical_idx, true AS same FROM p WHERE (contains(t, 'standalone') OR contains(t, 'separate')) AND (contains(t, 'consolidated') OR contains(t, 'group'))) b ON b.doc = want.doc AND b.logical_idx = want.pi AND want.w IS NOT NULL)
"""


def _scored(spark, sf):
    pages = A.relation(spark, sf, A.PAGES)
    return pages, locate.score_pages(pages).join(pages.select("doc", "page", "verified"), ["doc", "page"])


SCORES = _score_sql()


@query("o3_page_score", SCORES + "SELECT doc, logical_idx, code, round(score, 4) AS score, basis, headed FROM scored")
def o3(spark, sf):
    return _scored(spark, sf)[1].select("doc", "logical_idx", "code", F.round("score", 4).alias("score"), "basis", "headed")


@query("t2_verified_first", SCORES + "SELECT doc, code, basis, page, logical_idx, round(score, 4) AS score FROM ranked WHERE n = 1")
def t2(spark, sf):
    return locate.pick(_scored(spark, sf)[1]).withColumn("score", F.round("score", 4))


@query("o5_locate", SCORES + "SELECT doc, code, basis, page, logical_idx, round(score, 4) AS score FROM prim")
def o5(spark, sf):
    return locate.locate(_scored(spark, sf)[1]).select("doc", "code", "basis", "page", "logical_idx", F.round("score", 4).alias("score"))


@query("o6_alternate", SCORES + "SELECT doc, code, basis, page, logical_idx, round(score, 4) AS score FROM other")
def o6(spark, sf):
    pages, scored = _scored(spark, sf)
    out = locate.locate_alternate(scored, locate.locate(scored), pages)
    return out.select("doc", "code", "basis", "page", "logical_idx", F.round("score", 4).alias("score"))


@query("p26_any_located", SCORES + "SELECT doc, bool_or(page IS NOT NULL) AS located FROM prim GROUP BY doc")
def p26(spark, sf):
    return locate.locate(_scored(spark, sf)[1]).groupBy("doc").agg(F.bool_or(F.col("page").isNotNull()).alias("located"))


# --- the whole plan over statement pages of all orders (the synthetic corpus with its answers is for the tests) -----


@query("o7_line_parser", _items_sql(A.STATEMENT_WORDS_SQL))
def o7(spark, sf):
    return _items(layout.split_two_up(A.statement_words(spark, sf)))


@query("o13_pipeline")
def o13(spark, sf):
    return pipeline.run(A.statement_words(spark, sf))


# --- smaller operators by themselves -----------------------------------------------------------------------------


@query("p3_nonempty_pages", f"SELECT doc, logical_idx FROM ({PAGES}) WHERE length(trim(text)) >= 50")
def p3(spark, sf):
    return locate.readable(A.relation(spark, sf, A.PAGES)).select("doc", "logical_idx")


@query("p7_kerning_search", f"SELECT doc, logical_idx, regexp_matches(lower(text), 'balance sheet') OR regexp_matches(replace(lower(text), ' ', ''), 'balancesheet') AS found FROM ({PAGES})")
def p7(spark, sf):
    return A.relation(spark, sf, A.PAGES).select("doc", "logical_idx", T.search(F.lower("text"), "balance sheet").alias("found"))


FIRST = f"SELECT doc, logical_idx, lower(string_split(text, chr(10))[1]) AS line FROM ({PAGES})"


@query("p8_heading", f"SELECT doc, logical_idx, CASE WHEN regexp_matches(line, 'balance sheet') THEN len(list_filter(string_split_regex(regexp_extract(line, '^(.*?)(?:balance sheet)', 1), '\\s+'), lambda w: w <> '')) <= 2 ELSE regexp_matches(replace(line, ' ', ''), 'balancesheet') END AS heading FROM ({FIRST})")
def p8(spark, sf):
    line = F.lower(F.get(F.split("text", "\n"), F.lit(0)))
    return A.relation(spark, sf, A.PAGES).select("doc", "logical_idx", T.is_heading(line, ["balance sheet"]).alias("heading"))


CUES = {c: s[1] for c, s in SIGNATURES.items()}


@query("p14_continuation", f"SELECT doc, logical_idx, (regexp_matches(lower(text), {_lit('|'.join(CUES['CF']))})) AND len(regexp_extract_all(lower(text), {_lit(T.FIGURE)})) >= 8 AS continues FROM ({PAGES})")
def p14(spark, sf):
    return locate.continues(A.relation(spark, sf, A.PAGES), "CF").select("doc", "logical_idx", "continues")


@query("p27_name_filter", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('Red')) AND NOT starts_with(p_name, '_')")
def p27(spark, sf):
    return readers.named(spark.read.parquet(f"{sf}/part.parquet").withColumn("doc", F.col("p_name")), "Red").select("p_partkey", "p_name")


@query("p28_title_heading", "SELECT r_name AS text, len(string_split_regex(trim(r_name), '\\s+')) <= 5 AND r_name = upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) AND NOT regexp_matches(r_name, '\\d') AS heading FROM (SELECT r_name FROM region UNION ALL SELECT lower(r_name) FROM region UNION ALL SELECT upper(substr(r_name, 1, 1)) || lower(substr(r_name, 2)) FROM region WHERE r_name NOT LIKE '% %')")
def p28(spark, sf):
    spark_sql = "SELECT r_name AS text FROM {region} UNION ALL SELECT lower(r_name) FROM {region} UNION ALL SELECT concat(upper(substr(r_name, 1, 1)), lower(substr(r_name, 2))) FROM {region} WHERE r_name NOT LIKE '% %'"
    return A.relation(spark, sf, spark_sql).withColumn("heading", T.is_title_heading(F.col("text")))


@query("p29_by_status", VERDICTS.format(obs=OBS) + "SELECT doc, metric FROM verdict WHERE status = 'FLAGGED'")
def p29(spark, sf):
    return _verdicts(spark, sf).where("status = 'FLAGGED'").select("doc", "metric")


QUALITY = "CASE WHEN length(trim(text)) < 50 THEN 'EMPTY' WHEN length(array_to_string(regexp_extract_all(text, '[A-Za-z]{3,}'), '')) / greatest(length(text), 1) > 0.3 THEN 'OK' ELSE 'SUSPECT' END"
SCAN = f"SELECT doc, page, width, height, width > height AS landscape, text, {QUALITY} AS quality FROM (SELECT doc, page, max(CASE WHEN page % 3 = 0 THEN page_height ELSE page_width END) AS width, max(CASE WHEN page % 3 = 0 THEN page_width ELSE page_height END) AS height, string_agg(text, ' ' ORDER BY word_idx) AS text FROM ({A.WORDS_SQL}) GROUP BY doc, page)"


def _scan(spark, sf):
    return layout.page_scan(A.words(spark, sf).withColumn("rotation", F.when(F.col("page") % 3 == 0, 90).otherwise(0)))


@query("s1_page_scan", f"SELECT doc, page, width, height, landscape, md5(text) AS digest, quality FROM ({SCAN})")
def s1(spark, sf):
    return _scan(spark, sf).select("doc", "page", "width", "height", "landscape", F.md5("text").alias("digest"), "quality")


@query("a13_page_profile", f"SELECT doc, count(*) AS pages, count(*) FILTER (WHERE quality = 'OK') AS ok, count(*) FILTER (WHERE quality = 'SUSPECT') AS suspect, count(*) FILTER (WHERE quality = 'EMPTY') AS empty, round_even(avg(CAST(landscape AS INT)), 2) AS landscape FROM ({SCAN}) GROUP BY doc")
def a13(spark, sf):
    return report.page_profile(_scan(spark, sf))


@query("a18_x_columns", f"SELECT doc, count(DISTINCT round_even(x0 / 50, 0) * 50) AS columns FROM ({ROWS}) WHERE regexp_matches(replace(text, '.', ''), '^\\d+$') GROUP BY doc")
def a18(spark, sf):
    return A.relation(spark, sf, A.ROWS).where(F.translate("text", ".", "").rlike(r"^\d+$")).groupBy("doc").agg(F.count_distinct(F.bround(F.col("x0") / 50) * 50).alias("columns"))


@query("a6_sources", f"SELECT doc, metric, string_agg(DISTINCT source, ', ' ORDER BY source) AS sources FROM ({VOTES}) GROUP BY doc, metric")
def a6(spark, sf):
    return prove.consensus(A.relation(spark, sf, A.VOTES)).select("doc", "metric", F.array_join("sources", ", ").alias("sources"))


@query("w14_logical_pages", f"SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc ORDER BY page) - 1 AS INT) AS logical_idx, string_agg(text, ' ' ORDER BY word_idx) AS text FROM ({A.WORDS_SQL}) GROUP BY doc, page")
def w14(spark, sf):
    return layout.logical_pages(A.words(spark, sf).withColumn("half", F.lit(0))).select("doc", "page", "logical_idx", "text")


@query("t1_candidate_rank", SCORES + "SELECT doc, code, logical_idx, by_score AS place FROM ranked")
def t1(spark, sf):
    return locate.candidates(_scored(spark, sf)[1]).select("doc", "code", "logical_idx", "place")


@query("t6_text_sample", f"SELECT doc, string_agg(text, ' ' ORDER BY page) AS sample FROM ({PAGES}) WHERE page < 15 GROUP BY doc")
def t6(spark, sf):
    return locate.text_sample(A.relation(spark, sf, A.PAGES))


@query("t8_first_rows", f"SELECT doc, logical_idx, nth FROM (SELECT doc, logical_idx, CAST(row_number() OVER (PARTITION BY doc ORDER BY logical_idx) AS INT) AS nth FROM ({PAGES})) WHERE nth <= 3")
def t8(spark, sf):
    return report.samples(A.relation(spark, sf, A.PAGES), 3, ["doc"], ["logical_idx"]).select("doc", "logical_idx", "nth")


@query("j12_range_filter", f"""WITH n AS (SELECT * FROM ({ROWS}) WHERE {IS_NUMERIC.format(t='text')}), h AS (SELECT doc, x0 BETWEEN 100 AND 140 AS mine, x0, word_idx, text, bool_or(x0 BETWEEN 100 AND 140) OVER (PARTITION BY doc) AS found FROM n)
SELECT doc, string_agg(text, '|' ORDER BY word_idx) AS kept FROM h WHERE mine OR NOT found GROUP BY doc""")
def j12(spark, sf):
    rows = A.relation(spark, sf, A.ROWS).where(N.is_numeric(F.col("text"))).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("word_idx", "x0", "text"))).alias("nums"))
    ranges = F.array(*[F.struct(F.lit(n).alias("basis"), F.lit(a).alias("x0"), F.lit(b).alias("x1")) for n, a, b in (("standalone", 0.0, 100.0), ("consolidated", 100.0, 140.0))])
    return rows.select("doc", F.array_join(lines.values_of(lines.in_columns(F.col("nums"), ranges, F.lit("consolidated"))), "|").alias("kept"))


@query("j14_neighbour_pages", f"SELECT doc, logical_idx, lag(page) OVER (PARTITION BY doc ORDER BY logical_idx) IS NOT DISTINCT FROM page OR lead(page) OVER (PARTITION BY doc ORDER BY logical_idx) IS NOT DISTINCT FROM page AS same_page FROM (SELECT doc, logical_idx, page // 2 AS page FROM ({PAGES}))")
def j14(spark, sf):
    return locate.beside(A.relation(spark, sf, A.PAGES).selectExpr("doc", "logical_idx", "page div 2 AS page")).select("doc", "logical_idx", "same_page")


@query("f15_prior_values", f"SELECT doc, item_seq, nums[2:] AS prior FROM (SELECT doc, line_no AS item_seq, string_split(nums, '|') AS nums FROM ({SPLIT}) WHERE label <> '' AND nums <> '')".replace("nums[2:] AS prior", "array_to_string(nums[2:], '|') AS prior"))
def f15(spark, sf):
    items = lines.raw_items(layout.lines(_merged(spark, sf)))
    return items.select("doc", "item_seq", F.array_join(F.slice("values", F.lit(2), F.size("values")), "|").alias("prior"))


ITEM_SQL = f"SELECT 'd' || CAST(length(label) % 3 AS VARCHAR) AS doc, CASE length(label) % 2 WHEN 0 THEN 'PL' ELSE 'BS' END AS code, label, length(label) AS item_seq, 'current' AS side, CAST(length(label) * 1000 + 500 AS DOUBLE) AS value, {_clean_sql('label')} AS cleaned FROM ({LABELS})"
O8_SQL = f"""WITH b AS ({BEST}), i AS ({ITEM_SQL}), m AS (SELECT i.doc, i.code, b.metric, s.is_home, i.value, b.score, i.item_seq, i.label FROM i JOIN b ON b.label = i.cleaned JOIN (VALUES {_values([(home, m, True) for m, home, *_ in METRICS] + [(c, m, False) for m, _, also, *_ in METRICS for c in also])}) AS s(code, metric, is_home) ON s.code = i.code AND s.metric = b.metric)
SELECT doc, code, metric, is_home, value, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc, code, metric ORDER BY score DESC, item_seq, label) AS n FROM m) WHERE n = 1"""


def _normalized(spark, sf):
    items = A.relation(spark, sf, A.LABELS).selectExpr(
        "concat('d', length(label) % 3) AS doc", "'consolidated' AS basis", "CASE length(label) % 2 WHEN 0 THEN 'PL' ELSE 'BS' END AS code", "label", "0 AS page", "0 AS half", "length(label) AS item_seq", "'current' AS side",
        "array(concat(CAST(length(label) AS STRING), ',500')) AS values")
    return normalize.normalize(items)


@query("o8_normalise", O8_SQL)
def o8(spark, sf):
    return _normalized(spark, sf).select("doc", "code", "metric", "is_home", "value", F.round("score", 6).alias("score"))


@query("u3_home_precedence", f"SELECT doc, metric, code, value FROM (SELECT *, row_number() OVER (PARTITION BY doc, metric ORDER BY is_home DESC, code) AS k FROM ({O8_SQL})) WHERE k = 1")
def u3(spark, sf):
    return normalize.prefer_home(_normalized(spark, sf)).select("doc", "metric", "code", "value")


SCANNED = A.oracle(A.SCANNED)
LINE_SCAN = f"""SELECT doc, page, n, CASE WHEN regexp_matches(line, '\\d') AND len(parts) > 1 THEN '_table' WHEN regexp_matches(line, '\\d') THEN '_text' ELSE '_heading' END AS kind, line, parts
FROM (SELECT doc, page, n, trim(line) AS line, string_split_regex(trim(line), '\\s{{2,}}') AS parts FROM (SELECT doc, page, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM (SELECT doc, page, string_split(text, chr(10)) AS ls FROM ({SCANNED})))) WHERE line <> ''"""


@query("s9_line_scan", f"SELECT doc, page, CAST(n AS INT) AS n, kind, CASE kind WHEN '_table' THEN trim(parts[1]) ELSE line END AS label, CASE kind WHEN '_table' THEN array_to_string(parts[2:], '|') ELSE '' END AS values FROM ({LINE_SCAN})")
def s9(spark, sf):
    return layout.scan_lines(A.relation(spark, sf, A.SCANNED)).withColumn("values", F.array_join("values", "|"))


def _part(part: int) -> str:
    return f"SELECT kind, lower(CASE kind WHEN '_table' THEN trim(parts[1]) ELSE line END) AS label, CASE kind WHEN '_table' THEN parts[2:] ELSE [] END AS vals FROM s WHERE page % 2 = {part}"


@query("a19_compare_scans", f"""WITH s AS ({LINE_SCAN}), a AS ({_part(0)}), b AS ({_part(1)}), m AS (
  SELECT '_table' AS kind, (SELECT count(*) FROM a WHERE kind = '_table') AS n_a, (SELECT count(*) FROM b WHERE kind = '_table') AS n_b, (SELECT count(*) FROM a WHERE kind = '_table' AND (label, vals) IN (SELECT (label, vals) FROM b WHERE kind = '_table')) AS matched
  UNION ALL SELECT '_heading', (SELECT count(*) FROM a WHERE kind = '_heading'), (SELECT count(*) FROM b WHERE kind = '_heading'), (SELECT count(*) FROM a WHERE kind = '_heading' AND label IN (SELECT label FROM b WHERE kind = '_heading')))
SELECT kind, n_a, n_b, matched, matched / greatest(n_a, n_b) AS accuracy FROM m""")
def a19(spark, sf):
    lined = layout.scan_lines(A.relation(spark, sf, A.SCANNED))
    return report.compare_scans(lined.where("page % 2 = 0"), lined.where("page % 2 = 1"))
