from factloom.operators import layout, lines
from factloom.operators.layout import HALF

SCHEMA = "doc string, page int, half int, word_idx int, text string, x0 double, x1 double, top double"


def test_lines_are_worked_once(spark):
    """Floors come from a window: a join with them worked out all lines a second time."""
    words = [("Note", 100.0), ("2025", 200.0), ("Stock", 0.0), ("7", 100.0), ("1,500", 200.0)]
    df = spark.createDataFrame([("d", 0, 0, n, t, x, x + 20, 0.0 if n < 2 else 20.0) for n, (t, x) in enumerate(words)], SCHEMA)
    made = layout.lines(layout.merge_minus(layout.line_numbers(df)))
    rows = lines.parse_rows(made)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("LogicalRDD") == 1
    got = {r.label: [t.text for t in r.nums] for r in rows.collect()}
    assert got["Stock"] == ["1,500"]
    assert [r.floor for r in lines.value_floors(made).select(*HALF, "floor").collect()] == [132.0]


def test_blank_lines_bound_the_spread(spark):
    """Lines without label and numbers still count for where a half page begins and ends."""
    words = [("Note", 100.0, 0.0), ("2025", 120.5, 0.0), ("Stock", 110.0, 20.0), ("7", 101.0, 20.0), ("1,500", 121.0, 20.0), ("", 10.0, 40.0)]
    df = spark.createDataFrame([("d", 0, 0, n, t, x, x + 1, top) for n, (t, x, top) in enumerate(words)], SCHEMA)
    assert [r.floor for r in lines.value_floors(layout.lines(layout.line_numbers(df))).collect()] == [113.0]
    rows = lines.parse_rows(layout.lines(layout.line_numbers(df))).collect()
    assert [[t.text for t in r.nums] for r in rows] == [["2025"], ["1,500"]]
