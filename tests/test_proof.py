from factloom.operators import prove, report
from factloom.plans.dims import IDENTITIES, TIES

SCHEMA = "doc string, basis string, metric string, value double, source string, page int, seq long"


def verdicts(spark, values, expected):
    rows = [("d", "consolidated", m, float(v), "x", 0, n) for n, (m, v) in enumerate(values)]
    out = prove.derive(prove.validate(spark.createDataFrame(rows, SCHEMA), expected))
    return {r.metric: r for r in out.collect()}


def test_identity_holds_and_fails(spark):
    ok = verdicts(spark, [("total_assets", 300), ("total_liabilities", 200), ("total_equity", 100)], [])
    assert {r.status for r in ok.values()} == {"VERIFIED"}
    bad = verdicts(spark, [("total_assets", 999), ("total_liabilities", 200), ("total_equity", 100)], [])
    assert {r.status for r in bad.values()} == {"FLAGGED"}


def test_tie_lone_and_missing(spark):
    got = verdicts(spark, [("cash_and_equivalents", 500), ("closing_cash", 500), ("revenue", 7)], ["revenue", "inventories"])
    assert got["closing_cash"].status == "VERIFIED" and got["revenue"].status == "PROBABLE" and got["inventories"].status == "MISSING"


def test_derivation(spark):
    got = verdicts(spark, [("total_assets", 300), ("total_equity", 100)], ["total_liabilities"])
    assert (got["total_liabilities"].status, got["total_liabilities"].value) == ("DERIVED", 200.0)
    none = verdicts(spark, [("total_assets", 100), ("total_equity", 300)], ["total_liabilities"])
    assert none["total_liabilities"].status == "MISSING" and "non-positive" in none["total_liabilities"].failed[0]


def test_sign_and_optional_members(spark):
    got = verdicts(spark, [("profit_before_tax", 1200), ("net_profit", 900), ("tax_expense", -300)], [])
    assert {r.status for r in got.values()} == {"VERIFIED"}
    got = verdicts(spark, [("net_change_in_cash", 60), ("cash_from_operations", 100), ("cash_from_investing", -50), ("cash_from_financing", -30), ("fx_effect_on_cash", 40)], [])
    assert got["fx_effect_on_cash"].status == "VERIFIED"
    got = verdicts(spark, [("net_change_in_cash", 20), ("cash_from_operations", 100), ("cash_from_investing", -50), ("cash_from_financing", -30), ("fx_effect_on_cash", 40)], [])
    assert got["fx_effect_on_cash"].status == "PROBABLE" and got["net_change_in_cash"].status == "VERIFIED"


def test_voting(spark):
    got = verdicts(spark, [("revenue", 100), ("revenue", 101), ("revenue", 100.5)], [])
    assert got["revenue"].status == "VERIFIED" and got["revenue"].value == 100.5


def test_checks_worked_once_a_document(spark):
    """The plan spells each check's two sums out once, in no filter; a filter of the verdicts' size used to repeat them inlined."""
    obs = spark.createDataFrame([("d", "consolidated", "revenue", 1.0, "x", 0, 1)], SCHEMA)
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    for out in (prove.validate(obs), prove.prove(obs), prove.derive(prove.validate(obs))):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("format_number(") == 2 * (len(IDENTITIES) + len(TIES))
        assert not any("Filter" in line.split("(")[0] for line in plan.splitlines() if "format_number(" in line)
    spark.conf.unset("spark.sql.debug.maxToStringFields")


def test_proof_at_once_equals_its_steps(spark):
    rows = [(d, "consolidated", m, v, "x", 0, n) for d, vs in (("d", (300.0, 200.0, 100.0)), ("e", (300.0, None, 100.0)), ("f", (100.0, None, 300.0))) for n, (m, v) in enumerate(zip(("total_assets", "total_liabilities", "total_equity"), vs, strict=True)) if v is not None]
    obs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(str, prove.prove(obs).collect())) == sorted(map(str, prove.derive(prove.validate(obs)).collect()))


def test_scorecard_rolls_up_counts(spark):
    verdicts = spark.createDataFrame([("a", "FLAGGED"), ("a", "MISSING"), ("b", "MISSING")], "doc string, status string")
    out = report.scorecard(verdicts)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2
    assert {r.doc: (r.flagged, r.missing, r.verified) for r in out.collect()} == {"a": (1, 1, 0), "b": (0, 1, 0), None: (1, 2, 0)}


def test_consensus_keeps_one_list(spark):
    """Odd, even, null and no values, by one list a metric instead of three states that are written and merged."""
    rows = [("d", "b", m, v, s, p, p) for m, seen in {"odd": [(3.0, "y"), (1.0, "x"), (2.0, "x")], "even": [(4.0, "x"), (1.0, None)], "null": [(None, "x"), (5.0, "x")], "none": [(None, "x")]}.items() for p, (v, s) in enumerate(seen)]
    out = prove.consensus(spark.createDataFrame(rows, SCHEMA))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile(" not in plan and "collect_set(" not in plan
    got = {r.metric: (r.value, r.n, r.sources) for r in out.collect()}
    assert got == {"odd": (2.0, 3, ["x", "y"]), "even": (2.5, 2, ["x"]), "null": (5.0, 2, ["x"]), "none": (None, 1, ["x"])}


def test_documents_dealt_once_and_checked_outside_lambdas(spark):
    """Observations are dealt by document, one exchange in all; details and bits of checks are worked on plain columns below the explode."""
    obs = spark.createDataFrame([("d", "consolidated", "revenue", 1.0, "x", 0, 1)], SCHEMA)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    for out in (prove.validate(obs), prove.prove(obs), report.scorecard(prove.prove(obs)).where("doc is not null"), prove.validate(obs).where("status <> 'MISSING'").select("metric", "status")):
        executed = out._jdf.queryExecution().executedPlan().toString()
        by_doc = [line for line in executed.splitlines() if "Exchange hashpartitioning(doc" in line and "spark_grouping_id" not in line]
        assert len(by_doc) == 1 and "REPARTITION_BY_COL" in by_doc[0]
        plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
        explode = next(n for n, line in enumerate(plan) if "Generate" in line)
        assert not any("format_number(" in line for line in plan[:explode])
        assert not any("format_number(" in line and "lambda" in line for line in plan)
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_optional_members_and_votes_in_lists(spark):
    """An optional member is in a check's list only where it was taken or nothing holds; a vote stands before the checks."""
    cash = [("net_change_in_cash", 20), ("cash_from_operations", 100), ("cash_from_investing", -50), ("cash_from_financing", -30)]
    got = verdicts(spark, [*cash, ("fx_effect_on_cash", 40)], [])
    assert got["fx_effect_on_cash"].passed == [] and got["net_change_in_cash"].passed == ["cash_flow_total (20.0 vs 20.0)"]
    got = verdicts(spark, [(m, v + 900 * (m == "net_change_in_cash")) for m, v in cash] + [("fx_effect_on_cash", 40)], [])
    assert got["fx_effect_on_cash"].failed == ["cash_flow_total (920.0 vs 20.0)"]
    got = verdicts(spark, [("total_assets", 300), ("total_assets", 301), ("total_liabilities", 200), ("total_equity", 50)], [])
    assert got["total_assets"].passed == ["cross_extractor_voting"] and got["total_assets"].failed == ["balance_sheet_identity (300.5 vs 250.0)"] and got["total_assets"].status == "FLAGGED"


def test_checks_by_themselves(spark):
    """checked() says of each check what the verdicts' lists say, and the plan of one check makes no details and deals its own metrics only."""
    cash = [("net_change_in_cash", 20.0), ("cash_from_operations", 100.0), ("cash_from_investing", -50.0), ("cash_from_financing", -30.0)]
    docs = {
        "a": [("total_assets", 300.0), ("total_liabilities", 200.0), ("total_equity", 100.0), ("current_assets", 1.0), ("non_current_assets", 2.0)],
        "b": [("total_assets", 300.0), ("total_assets", 301.0), ("total_assets", 900.0), ("total_liabilities", 201.0), ("total_equity", 100.0)],
        "c": [*cash, ("fx_effect_on_cash", 40.0)], "d": [("net_change_in_cash", 60.0), *cash[1:], ("fx_effect_on_cash", 40.0)], "e": [("net_change_in_cash", 999.0), *cash[1:], ("fx_effect_on_cash", 40.0)],
        "f": [("profit_before_tax", 1200.0), ("net_profit", 900.0), ("tax_expense", -300.0), ("closing_cash", 5.0), ("cash_and_equivalents", 50.0)],
        "g": [("closing_cash", None), ("cash_and_equivalents", 50.0), ("revenue", 7.0)],
    }
    obs = spark.createDataFrame([(d, "consolidated", m, v, "x", 0, n) for d, seen in docs.items() for n, (m, v) in enumerate(seen)], SCHEMA)
    told = {}
    for r in prove.validate(obs).collect():
        for ok, texts in ((True, r.passed), (False, r.failed)):
            for name in (t.split(" (")[0] for t in texts if " (" in t):
                told.setdefault((r.doc, name, ok), []).append(r.metric)
    got = {(r.doc, r.check, r.ok): r.n_metrics for r in prove.checked(obs).collect()}
    assert got == {k: len(v) for k, v in told.items()} and len(got) == 8
    one = prove.checked(obs, ["cash_flow_total"])
    assert {(r.doc, r.check, r.ok, r.n_metrics) for r in one.collect()} == {("c", "cash_flow_total", True, 4), ("d", "cash_flow_total", True, 5), ("e", "cash_flow_total", False, 5)}
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "format_number(" not in plan and "total_assets" not in plan
