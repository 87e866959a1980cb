"""Rule tables of the engine. Everything here is data: each table can be replaced by a caller's own."""

from __future__ import annotations

# The canonical metrics in order, with statement, other statements, balance-sheet side and label wordings.
METRICS: list[tuple[str, str, list[str], str | None, list[str]]] = [
    ("revenue", "PL", [], None, ["revenue from operations", "net sales", "income from operations", "total revenues", "revenue", "sales", "turnover", "interest earned"]),
    ("other_income", "PL", [], None, ["other income", "other operating income"]),
    ("total_income", "PL", [], None, ["total income", "total revenue"]),
    ("total_expenses", "PL", [], None, ["total expenses", "total expenditure", "total costs and expenses"]),
    ("employee_costs", "PL", [], None, ["employee benefit expenses", "employee benefits expense", "staff costs", "personnel expenses"]),
    ("depreciation", "PL", ["CF"], None, ["depreciation and amortisation expense", "depreciation and amortization", "depreciation, amortisation and impairment", "depreciation amortisation and depletion expense", "depreciation of plant and equipment", "depreciation on fixed assets", "depreciation and amortisation"]),
    ("finance_costs", "PL", ["CF"], None, ["finance costs", "finance cost", "interest expense", "borrowing costs"]),
    ("profit_before_tax", "PL", [], None, ["profit before tax", "profit before income tax", "income before income taxes", "profit/(loss) before tax", "earnings before tax"]),
    ("tax_expense", "PL", [], None, ["total tax expense", "tax expense", "income tax expense", "provision for taxation", "income taxes"]),
    ("net_profit", "PL", [], None, ["profit for the year", "net profit", "profit after tax", "net income", "profit/(loss) for the year", "profit for the period", "net profit/loss", "net profit for the year before minority interest", "profit after tax for the year"]),
    ("total_comprehensive_income", "PL", [], None, ["total comprehensive income for the year", "total comprehensive income"]),
    ("eps_basic", "PL", [], None, ["basic earnings per share", "basic eps", "earnings per share basic", "basic (in rupees)", "basic (rs.)", "earnings per equity share basic", "earnings per equity share basic and diluted", "basic earnings per ordinary share in eur", "basic / diluted earnings per equity share after net movement"]),
    ("total_assets", "BS", [], None, ["total assets"]),
    ("non_current_assets", "BS", [], None, ["total non-current assets", "total non current assets", "non-current assets"]),
    ("current_assets", "BS", [], None, ["total current assets", "current assets"]),
    ("inventories", "BS", [], "current", ["inventories", "inventory"]),
    ("trade_receivables", "BS", [], "current", ["trade receivables", "accounts receivable", "sundry debtors"]),
    ("cash_and_equivalents", "BS", [], "current", ["cash and cash equivalents", "cash and bank balances"]),
    ("total_equity", "BS", [], None, ["total equity", "total shareholders' equity", "shareholders' funds", "equity attributable to owners", "equity"]),
    ("non_current_liabilities", "BS", [], None, ["total non-current liabilities", "total non current liabilities", "non-current provisions and liabilities"]),
    ("current_liabilities", "BS", [], None, ["total current liabilities", "current provisions and liabilities"]),
    ("total_liabilities", "BS", [], None, ["total liabilities"]),
    ("total_equity_and_liabilities", "BS", [], None, ["total equity and liabilities", "total liabilities and equity", "total liabilities and shareholders' equity", "total capital and liabilities"]),
    ("cash_from_operations", "CF", [], None, ["net cash generated from operating activities", "net cash from operating activities", "net cash flow from operating activities", "cash inflow/outflow from operating activities"]),
    ("cash_from_investing", "CF", [], None, ["net cash used in investing activities", "net cash from investing activities", "net cash flow from investing activities", "cash inflow/outflow from investing activities", "net cash flows generated from investing activities", "net cash generated from investing activities"]),
    ("cash_from_financing", "CF", [], None, ["net cash used in financing activities", "net cash from financing activities", "net cash flow from financing activities", "cash inflow/outflow from financing activities", "net cash flows generated from financing activities", "net cash generated from financing activities"]),
    ("net_change_in_cash", "CF", [], None, ["net increase/(decrease) in cash and cash equivalents", "net increase in cash and cash equivalents", "net change in cash and cash equivalents", "net decrease in cash and cash equivalents", "net increase in cash and cash equivalents during the year"]),
    ("fx_effect_on_cash", "CF", [], None, ["effect of exchange rate on cash and cash equivalents", "effect of exchange rate changes on cash and cash equivalents", "effects of exchange rate changes on cash and cash equivalents", "exchange differences on cash and cash equivalents", "effect of exchange differences on cash and cash equivalents", "effect of fluctuation in foreign currency translation reserve", "exchange difference on translation of foreign currency cash and cash equivalents"]),
    ("closing_cash", "CF", [], None, ["cash and cash equivalents at the end of the year", "cash and cash equivalents at end of the period", "closing cash and cash equivalents", "cash and cash equivalents as at the end of the year", "cash and cash equivalents as at december", "closing balance of cash and cash equivalents"]),
]
# Metrics that a document may lack.
OPTIONAL = ["fx_effect_on_cash"]
# Statement titles and cues (regular expressions, lower case).
SIGNATURES: dict[str, tuple[list[str], list[str]]] = {
    "BS": ([r"balance sheet", r"statement of financial position"], [r"total assets", r"equity and liabilities", r"total equity", r"non[- ]current assets", r"current liabilities", r"capital and liabilities", r"reserves and surplus", r"\bdeposits\b", r"\badvances\b", r"\bborrowings\b"]),
    "PL": ([r"statement of profit (?:and|or) loss", r"income statement", r"statement of (?:operations|income)", r"profit and loss account", r"statement of comprehensive income"], [r"revenue from operations", r"total income", r"profit before tax", r"earnings per (?:equity )?share", r"total expenses", r"gross profit", r"cost of sales", r"profit for the year", r"income tax expense"]),
    "CF": ([r"(?:statement of )?cash flows?", r"cash flow statement"], [r"operating activities", r"investing activities", r"financing activities"]),
}
# Unit wordings in order: pattern, unit, currency, multiplier.
UNITS: list[tuple[str, str, str, float]] = [
    (r"(?:₹|rs\.?|rupees?)\s+(?:in\s+)?crores?", "Crores", "INR", 1e7),
    (r"(?:₹|rs\.?|rupees?)\s+(?:in\s+)?lakhs?", "Lakhs", "INR", 1e5),
    (r"(?:₹|rs\.?|rupees?)\s+(?:in\s+)?millions?", "Millions", "INR", 1e6),
    (r"(?:₹|rs\.?|rupees?)\s+(?:in\s+)?thousands?", "Thousands", "INR", 1e3),
    (r"usd\s+(?:in\s+)?millions?|\$\s+(?:in\s+)?millions?", "Millions", "USD", 1e6),
    (r"usd\s+(?:in\s+)?thousands?|\$\s+(?:in\s+)?thousands?", "Thousands", "USD", 1e3),
    (r"eur|€\s+(?:in\s+)?millions?", "Millions", "EUR", 1e6),
    (r"in\s+crores?", "Crores", "INR", 1e7),
    (r"in\s+lakhs?", "Lakhs", "INR", 1e5),
    (r"in\s+millions?", "Millions", "UNKNOWN", 1e6),
    (r"in\s+thousands?", "Thousands", "UNKNOWN", 1e3),
]
# Fixed value: a reporting date or fiscal year, after an optional lead-in; the first group is the date.
PERIOD = r"(?:as\s+at|as\s+of|for\s+the\s+year\s+ended)?\s*(\d{1,2}(?:st|nd|rd|th)?\s+(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{4}|\d{4}-\d{2}-\d{2}|fy\s*\d{2,4})"
# Identities: name, left side, right side, optional members of the right side.
IDENTITIES: list[tuple[str, list[str], list[str], list[str]]] = [
    ("balance_sheet_identity", ["total_assets"], ["total_liabilities", "total_equity"], []),
    ("equity_liabilities_total", ["total_assets"], ["total_equity_and_liabilities"], []),
    ("assets_composition", ["total_assets"], ["current_assets", "non_current_assets"], []),
    ("liabilities_composition", ["total_liabilities"], ["current_liabilities", "non_current_liabilities"], []),
    ("total_income_buildup", ["total_income"], ["revenue", "other_income"], []),
    ("net_profit_buildup", ["profit_before_tax"], ["net_profit", "tax_expense"], []),
    ("cash_flow_total", ["net_change_in_cash"], ["cash_from_operations", "cash_from_investing", "cash_from_financing"], ["fx_effect_on_cash"]),
]
# Metrics printed with either sign; one number in two statements.
SIGN_AMBIGUOUS = ["tax_expense"]
TIES: list[tuple[str, str, str]] = [("closing_cash_ties_to_balance_sheet", "cash_and_equivalents", "closing_cash")]
# Derivations in order: target, signed inputs.
DERIVATIONS: list[tuple[str, list[tuple[str, int]]]] = [
    ("total_liabilities", [("total_equity_and_liabilities", 1), ("total_equity", -1)]),
    ("total_liabilities", [("total_assets", 1), ("total_equity", -1)]),
    ("total_equity", [("total_equity_and_liabilities", 1), ("total_liabilities", -1)]),
    ("total_equity", [("total_assets", 1), ("total_liabilities", -1)]),
    ("current_assets", [("total_assets", 1), ("non_current_assets", -1)]),
    ("non_current_assets", [("total_assets", 1), ("current_assets", -1)]),
    ("current_liabilities", [("total_liabilities", 1), ("non_current_liabilities", -1)]),
    ("non_current_liabilities", [("total_liabilities", 1), ("current_liabilities", -1)]),
    ("total_equity_and_liabilities", [("total_assets", 1)]),
    ("total_assets", [("total_equity_and_liabilities", 1)]),
    ("total_income", [("revenue", 1), ("other_income", 1)]),
    ("total_expenses", [("total_income", 1), ("profit_before_tax", -1)]),
    ("total_expenses", [("revenue", 1), ("other_income", 1), ("profit_before_tax", -1)]),
    ("tax_expense", [("profit_before_tax", 1), ("net_profit", -1)]),
]
# Tolerances and thresholds.
RELATIVE, FLOOR = 0.005, 2.0
LINE_TOLERANCE, SIGN_GAP, REF_MARGIN, MAX_VALUE_COLUMNS, MIN_SPREAD = 2.5, 4.0, 12.0, 3, 50.0
GUTTER_BINS, GUTTER_LOW, GUTTER_HIGH = 200, 70, 130
MATCH_SCORE, NOTE_FACTOR = 88.0, 100.0

METRIC_NAMES = [m[0] for m in METRICS]
EXPECTED = [m for m in METRIC_NAMES if m not in OPTIONAL]
STATUSES = ["FLAGGED", "MISSING", "DERIVED", "VERIFIED", "PROBABLE"]
