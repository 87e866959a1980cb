"""Proof: consensus, identities, ties, statuses (O9) and derivation of absent values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import let, within
from ..plans.dims import DERIVATIONS, EXPECTED, IDENTITIES, SIGN_AMBIGUOUS, TIES

KEYS = ["doc", "basis"]


def consensus(obs: DataFrame) -> DataFrame:
    """Per metric the median, its sources, the page of the observation next to it, and the vote (null for one)."""
    seen = F.collect_list(F.struct("seq", "value", "page", "source")).alias("seen")
    g = obs.groupBy(*KEYS, "metric").agg(seen)  # all else follows from the list, which the vote needs anyway
    values = F.array_sort(F.filter(F.transform("seen", lambda o: o["value"]), lambda x: x.isNotNull()))
    at = lambda x, odd: F.get(x, F.floor((F.size(x) - odd) / 2).cast("int"))
    median = let(values, lambda x: let(F.struct(at(x, 1).alias("a"), at(x, 0).alias("b")), lambda m: F.when(m["a"] == m["b"], m["a"]).otherwise(m["a"] * 0.5 + m["b"] * 0.5)))
    sources = F.array_sort(F.array_distinct(F.filter(F.transform("seen", lambda o: o["source"]), lambda x: x.isNotNull())))
    lone, one = F.size("seen") == 1, F.get("seen", F.lit(0))  # most metrics are seen once, and then no list is worked
    median = F.when(lone, one["value"]).otherwise(median)
    sources = F.when(lone & one["source"].isNotNull(), F.array(one["source"])).otherwise(sources)
    g = g.select(*KEYS, "metric", "seen", median.alias("value"), F.size("seen").cast("long").alias("n"), sources.alias("sources"))
    nearest = let(F.col("value"), lambda v: F.array_min(F.transform("seen", lambda o: F.struct(F.abs(o["value"] - v).alias("gap"), o["seq"].alias("seq"), o["page"].alias("page")))))
    page = F.when(lone, one["page"]).otherwise(nearest["page"])
    vote = F.when(F.col("n") > 1, let(F.col("value"), lambda v: F.forall("seen", lambda o: within(o["value"], v))))
    return g.select(*KEYS, "metric", "value", "n", "sources", page.alias("page"), vote.alias("vote"))


def _sum(v, metrics: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [v(m) for m in metrics])


def _ties_any(v, lhs: list[str], rhs: list[str]) -> Column:
    """A3, A4: the sums agree, with a negative sign-ambiguous member taken either way."""
    out = within(_sum(v, lhs), _sum(v, rhs))
    for m in [m for m in rhs if m in SIGN_AMBIGUOUS]:
        out = out | ((v(m) < 0) & within(_sum(v, lhs), _sum(v, rhs) - 2 * v(m)))
    return out


def check_detail(name: str, lhs: Column, rhs: Column) -> Column:
    """a check's name with both sums, to one decimal."""
    return F.concat(F.lit(f"{name} ("), F.format_number(lhs, 1), F.lit(" vs "), F.format_number(rhs, 1), F.lit(")"))


#: A check's own metrics have the bit of its place, the optional ones that it takes in the bit _MORE places on.
_MORE = len(IDENTITIES) + len(TIES)


def checks(v) -> tuple[list[Column], Column, Column]:
    """The checks of one document in order, for v(metric) -> value: their details (null where one does not
    apply), and as bits which hold and which fail."""
    details, holds, fails = [], [], []

    def put(there: Column, detail: Column, ok: Column, taken: Column | None = None) -> None:
        own = F.lit(1 << len(details)).cast("long")
        bits = own if taken is None else own + F.when(taken, F.lit(1 << len(details) + _MORE).cast("long")).otherwise(F.lit(0))
        details.append(F.when(there, detail))
        holds.append(F.when(there & ok, bits).otherwise(F.lit(0).cast("long")))
        fails.append(F.when(there & ~ok, bits).otherwise(F.lit(0).cast("long")))

    for name, lhs, rhs, more in IDENTITIES:
        there = reduce(lambda a, b: a & b, [v(m).isNotNull() for m in lhs + rhs])
        ok, taken = F.coalesce(_ties_any(v, lhs, rhs), F.lit(False)), None
        if more:
            has = reduce(lambda a, b: a & b, [v(m).isNotNull() for m in more])
            wide = F.coalesce(has & _ties_any(v, lhs, rhs + more), F.lit(False))
            ok, taken = wide | ok, has & (wide | ~(wide | ok))
        put(there, check_detail(name, _sum(v, lhs), _sum(v, rhs)), ok, taken)
    for name, a, b in TIES:
        put(v(a).isNotNull() & v(b).isNotNull(), check_detail(name, v(a), v(b)), F.coalesce(within(v(a), v(b)), F.lit(False)))
    return details, reduce(lambda x, y: x + y, holds), reduce(lambda x, y: x + y, fails)


def _marks() -> dict[str, int]:
    """The bits of each metric in what checks() gives."""
    marks: dict[str, int] = {}
    for n, (lhs, rhs, more) in enumerate([i[1:] for i in IDENTITIES] + [([a], [b], []) for _, a, b in TIES]):
        for m in lhs + rhs + more:
            marks[m] = marks.get(m, 0) | 1 << n + (_MORE if m in more else 0)
    return marks


def _values(metrics: list[str]) -> list[Column]:
    """The values of these metrics as columns, for a fold of the consensus by document."""
    return [F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in metrics]


def checked(obs: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A row a document, basis and check that applies: check, whether it is ok, and how many metrics it has.

    names, if given, are the checks asked for. No other metrics than theirs bear on the result, so that only these are dealt,
    and no facts, details or verdicts are made.
    """
    every = [(name, {*lhs, *rhs}, more) for name, lhs, rhs, more in IDENTITIES] + [(name, {a, b}, []) for name, a, b in TIES]
    wanted = [(n, *check) for n, check in enumerate(every) if names is None or check[0] in names]
    metrics = sorted({m for _, _, own, more in wanted for m in (*own, *more)})
    docs = consensus(obs.where(F.col("metric").isin(metrics)).repartition("doc")).groupBy(*KEYS).agg(*_values(metrics))
    _, holds, fails = checks(lambda m: F.col(m) if m in metrics else F.lit(None).cast("double"))
    docs = docs.select(*KEYS, holds.alias("holds"), fails.alias("fails"))
    bit = lambda bits, n: F.bit_get(F.col(bits), F.lit(n)) == 1
    either = lambda n: bit("holds", n) | bit("fails", n)
    count = lambda n, own, more: (F.lit(len(own)) + F.when(either(n + _MORE), len(more)).otherwise(0)).cast("long")
    rows = F.array(*[F.struct(F.lit(name).alias("check"), either(n).alias("applies"), bit("holds", n).alias("ok"), count(n, own, more).alias("n_metrics")) for n, name, own, more in wanted])
    return docs.select(*KEYS, F.explode(rows).alias("r")).where("r.applies").select(*KEYS, "r.check", "r.ok", "r.n_metrics")


_FACT = "struct<value: double, sources: array<string>, page: int, vote: boolean>"
_FIELDS = ["metric", "status", "value", "sources", "page", "passed", "failed"]


def _documents(obs: DataFrame, sheets: DataFrame | None) -> DataFrame:
    """One row a document and basis: its facts (metric, fact), the details of its checks, and the bits of those that hold and fail.

    The observations are dealt by document at once, and all that follows a document needs no other exchange. The values
    that checks ask for leave the fold as columns, so that the checks are plain expressions over one row and not worked
    within a lambda.
    """
    fact = F.struct("value", "sources", "page", "vote").cast(_FACT).alias("fact")
    docs = consensus(obs.repartition("doc")).groupBy(*KEYS).agg(F.collect_list(F.struct("metric", fact)).alias("facts"), *_values(list(_marks())))
    if sheets is not None:
        docs = sheets.select(*KEYS).join(docs, KEYS, "left").withColumn("facts", F.coalesce("facts", F.array().cast(f"array<struct<metric: string, fact: {_FACT}>>")))
    details, holds, fails = checks(F.col)
    return docs.select(*KEYS, "facts", F.array(*details).alias("details"), holds.alias("holds"), fails.alias("fails"))


def _status(fact: Column, holds: Column, fails: Column) -> Column:
    """A9, from the bits of the fact's own checks."""
    return F.when(fact.isNull(), "MISSING").when((fails != 0) | ~fact["vote"], "FLAGGED").when((holds != 0) | fact["vote"], "VERIFIED").otherwise("PROBABLE")


def _verdicts(docs: DataFrame, expected: list[str], *kept: str) -> DataFrame:
    """A row a document, basis and metric, with its verdict and the columns `kept` of _documents().

    The array is exploded as it stands: of a column, the optimizer would ask its size in a filter below the step that
    makes it, and so work all of it again.
    """
    absent = F.array_except(F.array(*map(F.lit, expected)).cast("array<string>"), F.transform("facts", lambda f: f["metric"]))
    every = F.concat("facts", F.transform(absent, lambda m: F.struct(m.alias("metric"), F.lit(None).cast(_FACT).alias("fact"))))
    rows = docs.select(*KEYS, "details", "holds", "fails", *kept, F.explode(every).alias("r"))
    marks = F.coalesce(F.create_map(*[x for m, bits in _marks().items() for x in (F.lit(m), F.lit(bits).cast("long"))])[F.col("r")["metric"]], F.lit(0).cast("long"))
    rows = rows.select(*KEYS, "r.*", "details", *kept, F.col("holds").bitwiseAND(marks).alias("holds"), F.col("fails").bitwiseAND(marks).alias("fails"))
    none = F.array().cast("array<string>")

    def listed(bits: str, ok: bool) -> Column:
        voted = F.when(F.col("fact")["vote"] == ok, F.array(F.lit("cross_extractor_voting"))).otherwise(none)
        own = F.filter("details", lambda d, n: (F.bit_get(F.col(bits), n) == 1) | (F.bit_get(F.col(bits), n + _MORE) == 1))
        return F.concat(voted, F.when(F.col(bits) != 0, own).otherwise(none))

    fact = F.col("fact")
    return rows.select(*KEYS, "metric", _status(fact, F.col("holds"), F.col("fails")).alias("status"), fact["value"].alias("value"), F.coalesce(fact["sources"], none).alias("sources"), fact["page"].alias("page"), listed("holds", True).alias("passed"), listed("fails", False).alias("failed"), *kept)


def validate(obs: DataFrame, expected: list[str] = EXPECTED, sheets: DataFrame | None = None) -> DataFrame:
    """One verdict a document, basis and metric; expected metrics without an observation are MISSING.

    sheets (doc, basis), if given, names what gets verdicts, even where nothing was observed.
    """
    return _verdicts(_documents(obs, sheets), expected)


def prove(obs: DataFrame, expected: list[str] = EXPECTED, sheets: DataFrame | None = None) -> DataFrame:
    """O9, then O10, without folding a document's verdicts again between them."""
    docs = _documents(obs, sheets).withColumn("m", F.map_from_entries("facts"))
    marks = _marks()
    own = lambda bits, x: F.col(bits).bitwiseAND(F.lit(marks.get(x, 0)).cast("long"))
    status = {x: _status(F.col("m")[x], own("holds", x), own("fails", x)).alias(f"status_{x}") for x in _inputs()}
    docs = docs.select(*KEYS, "facts", "details", "holds", "fails", "m", *status.values())
    best = _best(lambda x: (F.col(f"status_{x}"), F.col("m")[x]["value"], F.col("m")[x]["page"]), lambda t: F.col("m")[t].isNull())
    return _filled(_verdicts(docs.withColumn("best", best), expected, "best"))


def _initial(status: Column) -> Column:
    return F.substring(status, 1, 1)


def derive(verdicts: DataFrame) -> DataFrame:
    """MISSING values that an identity pins down from VERIFIED or PROBABLE ones.

    Of the formulas whose inputs are all trusted the one with the fewest PROBABLE inputs wins, then the first. A result
    that is not positive stays MISSING and leaves a note. One pass: derived values feed no formula.
    """
    docs = verdicts.groupBy(*KEYS).agg(F.collect_list(F.struct(*_FIELDS)).alias("rows"))
    docs = docs.withColumn("m", F.map_from_entries(F.transform("rows", lambda r: F.struct(r["metric"], r))))
    best = _best(lambda x: tuple(F.col("m")[x][f] for f in ("status", "value", "page")), lambda t: F.col("m")[t]["status"] == "MISSING")
    return _filled(docs.select(*KEYS, "rows", best.alias("best")).select(*KEYS, "best", F.explode("rows").alias("r")).select(*KEYS, "r.*", "best"))


def _inputs() -> list[str]:
    """The metrics that derivations start from."""
    return list(dict.fromkeys(x for _, formula in DERIVATIONS for x, _ in formula))


def _best(of, absent) -> Column:
    """The best formula's result for each target that a document lacks, as a map, for of(metric) -> status, value, page."""

    def candidate(n: int, formula) -> Column:
        inputs = [of(x) for x, _ in formula]
        trusted = reduce(lambda a, b: a & b, [F.coalesce(status.isin("VERIFIED", "PROBABLE"), F.lit(False)) for status, _, _ in inputs])
        unproven = reduce(lambda a, b: a + b, [(status != "VERIFIED").cast("int") for status, _, _ in inputs])
        value = reduce(lambda a, b: a + b, [s * value for (_, s), (_, value, _) in zip(formula, inputs, strict=True)])
        text = F.concat(*[F.concat(F.lit(("" if k == 0 and s > 0 else " " if k else "") + ("- " if s < 0 else "+ " if k else "") + x + "["), _initial(status), F.lit("]")) for k, ((x, s), (status, _, _)) in enumerate(zip(formula, inputs, strict=True))])
        return F.when(trusted, F.struct(unproven.alias("unproven"), F.lit(n).alias("ord"), value.alias("value"), inputs[0][2].alias("page"), text.alias("expr")))

    targets = list(dict.fromkeys(t for t, _ in DERIVATIONS))
    best = lambda t: F.when(absent(t), F.array_min(F.array_compact(F.array(*[candidate(n, f) for n, (x, f) in enumerate(DERIVATIONS) if x == t]))))
    return F.create_map(*[x for t in targets for x in (F.lit(t), best(t))])


def _filled(rows: DataFrame) -> DataFrame:
    """Verdicts with what derivation found for their document (`best`) in the place of what is MISSING."""
    rows = rows.select(*KEYS, *_FIELDS, F.when(F.col("status") == "MISSING", F.col("best")[F.col("metric")]).alias("found"))
    d = F.col("found")
    good, bad = d.isNotNull() & (d["value"] > 0), d.isNotNull() & ~(d["value"] > 0)
    note = lambda text: F.array(F.concat(F.lit(text), d["expr"]))
    pick = lambda name, made: F.when(good, made).otherwise(F.col(name)).alias(name)
    failed = F.when(bad, F.concat("failed", note("derivation discarded (non-positive): "))).when(good, F.array().cast("array<string>")).otherwise(F.col("failed"))
    return rows.select(*KEYS, "metric", pick("status", F.lit("DERIVED")), pick("value", d["value"]), pick("sources", F.array(F.lit("derived"))), pick("page", d["page"]), pick("passed", note("derived: ")), failed.alias("failed"))
