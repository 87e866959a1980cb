"""A small synthetic corpus of statement pages, as words with coordinates; it stands in for a page reader's output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.readers import WORDS

#: Per document: pages, each a list of lines; a line is its label and the numbers by column, the first column being references.
COLUMNS = (300.0, 400.0, 480.0)
SHEET = [
    ("Consolidated Balance Sheet", []), ("Particulars", ["Note", "2025", "2024"]), ("ASSETS", []), ("Non-current assets", []), ("Plant and equipment", ["3", "4,000", "3,900"]),
    ("Total non-current assets", ["", "6,000", "5,500"]), ("Current assets", []), ("Inventories", ["10", "1,500", "1,400"]), ("Trade receivables", ["11", "2,000", "1,900"]),
    ("Cash and cash equivalents", ["12", "500", "450"]), ("Total current assets", ["", "4,000", "3,750"]), ("Total assets", ["", "10,000", "9,250"]), ("EQUITY AND LIABILITIES", []),
    ("Total equity", ["", "6,500", "6,000"]), ("Total liabilities", ["", "3,500", "3,250"]), ("Total equity and liabilities", ["", "10,000", "9,250"]),
]
PROFIT = [
    ("Consolidated Statement of Profit and Loss", []), ("Particulars", ["Note", "2025", "2024"]), ("Revenue from operations", ["20", "9,000", "8,000"]), ("Other income", ["21", "100", "90"]),
    ("Total income", ["", "9,100", "8,090"]), ("Profit before tax", ["", "1,200", "1,000"]), ("Tax expense", ["", "(300)", "250"]), ("Profit for the year, representing total", []),
    ("comprehensive income for the year", ["", "900", "750"]), ("Net profit", ["", "900", "750"]), ("EARNINGS PER EQUITY SHARE (Face value 10 each)", []), ("Basic", ["", "8.05", "7.10"]),
]
FLOWS = [
    ("Consolidated Cash Flow Statement", []), ("Particulars", ["Note", "2025", "2024"]), ("Net cash from operating activities", ["", "800.00", "700.00"]), ("Net cash used in investing activities", ["", "(500.00)", "(450.00)"]),
    ("Net cash used in financing activities", ["", "(250.00)", "(200.00)"]), ("Net increase in cash and cash equivalents", ["", "50.00", "50.00"]), ("Cash and cash equivalents at the end of the year", ["", "500.00", "450.00"]), ("Depreciation and amortisation", ["5", "321.00", "300.00"]),
]
#: An unlabelled subtotal that a total closes, and one that a labelled row discards; a detached minus.
SUBTOTALS = [
    ("Consolidated Balance Sheet", []), ("Particulars", ["Note", "2025", "2024"]), ("Non-current assets", []), ("Plant", ["3", "4,000", "3,900"]), ("", ["", "6,000", "5,500"]), ("Current assets", []), ("Inventories", ["10", "4,000", "3,750"]),
    ("", ["", "4,000", "3,750"]), ("Total assets", ["", "10,000", "9,250"]), ("Current liabilities", []), ("", ["", "77", "66"]), ("Other payables", ["", "1,000", "900"]), ("Total liabilities", ["", "3,500", "3,250"]), ("Reserve", ["", "− 1,250", "1,100"]), ("Equity and liabilities", []),
]
#: Landscape, one table: labels on the left half, nothing but numbers on the right one.
WIDE = [("Consolidated Balance Sheet", []), ("Particulars of the group at the end of each year", ["2025", "2024"])] + [(f"{name} and all that belongs to it as described", [f"{9 + k},000", f"{8 + k},000"]) for k, name in enumerate(("Land", "Plant", "Goodwill", "Loans", "Inventories", "Receivables", "Cash", "Deposits"))] + [("Total assets", ["90,000", "80,000"]), ("Total equity", ["50,000", "45,000"]), ("Total liabilities", ["40,000", "35,000"])]
#: A sign hugs its number; a dash in its own column is nil.
MINUS = [("Income Statement", []), ("Particulars", ["", "2025", "2024"]), ("Revenue", ["", "90,000", "80,000"]), ("Cost of sales", ["", "− 50,000", "− 45,000"]), ("Gross profit", ["", "40,000", "35,000"]), ("Profit before tax", ["", "20,000", "16,000"]), ("Income tax expense", ["", "− 5,000", "4,000"]), ("Net profit", ["", "15,000", "12,000"]), ("Other operating income", ["−", "−", "10,000"])]
#: Bare totals under numbered headings; earnings by Basic and Diluted.
BANK = [
    ("Consolidated Balance Sheet", []), ("Schedule", ["", "2025", "2024"]), ("I. EQUITY AND LIABILITIES", []), ("Capital", ["1", "10,000", "10,000"]), ("Reserves and surplus", ["2", "40,000", "35,000"]), ("Deposits", ["3", "150,000", "120,000"]), ("Total", ["", "200,000", "165,000"]),
    ("II. ASSETS", []), ("Advances", ["4", "180,000", "150,000"]), ("Cash and bank balances", ["5", "20,000", "15,000"]), ("Total:", ["", "200,000", "165,000"]), ("EARNINGS PER EQUITY SHARE (Face value 2 each)", []), ("Basic", ["", "12.50", "11.25"]), ("Diluted", ["", "12.25", "11.00"]),
]
#: References that no heading announces: note alone, note and page, decimal note; a value of three digits; a label that ends in a note.
REFERENCES = [
    ("Consolidated Balance Sheet", []), ("Trade receivables", ["12", "45,000.00", "40,000.00"]), ("Inventories", ["10", "289 9,869.49", "8,100.00"]), ("Cash and cash equivalents", ["5.5", "7,500.00", "6,500.00"]), ("Total current assets", ["", "62,369.49", "54,600.00"]),
    ("Total non-current assets", ["", "718", "640"]), ("Total assets", ["", "63,087.49", "55,240.00"]), ("Total equity 4(e)", ["21", "28"]), ("Total liabilities", ["", "63,066.49", "55,212.00"]),
]
#: Labels over two lines, and a parenthesis that the numbers' tail has taken.
WRAPPED = [
    ("Consolidated Cash Flow Statement", []), ("Particulars", ["", "2025", "2024"]), ("Net cash generated from", []), ("operating activities", ["", "80,000", "70,000"]), ("Net cash used in investing activities", ["", "(50,000)", "(45,000)"]), ("Net cash used in financing activities", ["", "(25,000)", "(20,000)"]),
    ("Net increase in cash and cash equivalents", ["", "5,000", "5,000"]), ("Cash and cash equivalents at the end of the year (refer note", ["15)", "50,000", "45,000"]),
]
#: Columns of both bases on one page.
DUAL = [("Balance Sheet", []), ("", ["", "Standalone", "", "Consolidated"])] + [(label, ["", f"{n},000", "", f"{3 * n},000"]) for label, n in (("Total non-current assets", 6), ("Total current assets", 4), ("Total assets", 10), ("Total equity", 7), ("Total liabilities", 3), ("Total equity and liabilities", 10))]
DUAL_COLUMNS = (260.0, 320.0, 400.0, 470.0)
#: Pages that only look like a balance sheet, before the one that is.
CONTENTS = [("Contents", []), ("Balance sheet", ["12"]), ("Total assets and total equity", ["13"]), ("Notes", ["14"])]
OVERVIEW = [("Ten years of the balance sheet", [])] + [(f"Total assets and total equity {y}", ["", f"{y}0,000", f"{y}5,000"]) for y in range(11, 19)] + [("Years 2016 2017 2018 2019 2020 2021 2022 2023 2024 2025", [])]
CONDENSED = [("Condensed Balance Sheet", [])] + [(label, ["", "11,000", "12,000"]) for label in ("Total assets", "Total equity", "Current liabilities", "Borrowings", "Deposits")]
PROSE = [("Provisions are reviewed at each balance sheet date", [])] + [(label, ["", "21,000", "22,000"]) for label in ("Total assets", "Total equity", "Current liabilities", "Borrowings", "Deposits")]
#: An identity that fails, a negative tax, an exchange effect within the sum, totals that are absent.
BROKEN = [("Consolidated Balance Sheet", []), ("Particulars", ["", "2025", "2024"]), ("Total assets", ["", "99,900", "10,000"]), ("Total equity", ["", "10,000", "9,000"]), ("Total liabilities", ["", "20,000", "1,000"]), ("Current liabilities", []), ("Loans", ["", "11,000", "10,000"])]
TAXED = [("Consolidated Income Statement", []), ("Particulars", ["", "2025", "2024"]), ("Revenue", ["", "50,000", "45,000"]), ("Other income", ["", "1,000", "2,000"]), ("Profit before tax", ["", "12,000", "10,000"]), ("Tax expense", ["", "(3,000)", "2,500"]), ("Net profit", ["", "9,000", "7,500"]), ("Earnings per share basic", ["", "1.25", "1.10"])]
EXCHANGED = [("Consolidated Cash Flow Statement", []), ("Particulars", ["", "2025", "2024"]), ("Net cash from operating activities", ["", "10,000", "9,000"]), ("Net cash used in investing activities", ["", "(5,000)", "(4,000)"]), ("Net cash used in financing activities", ["", "(3,000)", "(2,000)"]), ("Effect of exchange rate changes on cash and cash equivalents", ["", "1,000", "1,000"]), ("Net increase in cash and cash equivalents", ["", "3,000", "4,000"])]


def _words(doc: str, page: int, lines, left: float = 20.0, columns=COLUMNS, size=(600.0, 800.0), upright: bool = True, first: int = 0, top: float = 20.0) -> list[tuple]:
    out = []
    for n, (label, numbers) in enumerate(lines):
        x = left
        placed = []
        for w in label.split():
            placed.append((w, x, x + 5.0 * len(w)))
            x += 5.0 * len(w) + 4
        for at, number in zip(columns, numbers, strict=False):
            at += left - 20.0
            for w in number.split():
                placed.append((w, at, at + (5.0 if len(w) == 1 else 5.0 * len(w))))
                at = placed[-1][2] + 3
        out += [(doc, page, *size, first + len(out) + i, w, a, b, top + 14.0 * n, upright) for i, (w, a, b) in enumerate(placed)]
    return out


def _documents() -> dict[str, list[list[tuple]]]:
    """Words of each document's pages."""
    pages = lambda doc, *sheets, **more: [_words(doc, p, lines, **more) for p, lines in enumerate(sheets)]
    sheet, tab = (1200.0, 800.0), [("Financial", []), ("Statements", [])]
    return {
        "d01": pages("d01", SHEET, PROFIT, FLOWS),
        "d02": [_words("d02", 0, SHEET, size=sheet) + _words("d02", 0, PROFIT, left=640.0, size=sheet, first=1000)],
        "d03": pages("d03", WIDE, columns=(640.0, 800.0), size=sheet),
        "d04": pages("d04", MINUS, columns=(300.0, 400.0, 480.0)),
        "d05": pages("d05", SUBTOTALS),
        "d06": pages("d06", BANK),
        "d07": pages("d07", REFERENCES),
        "d08": pages("d08", WRAPPED, columns=(400.0, 450.0, 520.0)),
        "d09": pages("d09", DUAL, columns=DUAL_COLUMNS),
        "d10": pages("d10", CONTENTS, OVERVIEW, CONDENSED, PROSE, SHEET),
        "d11": pages("d11", BROKEN, TAXED, EXCHANGED, columns=(330.0, 400.0, 480.0)),
        "d12": [_words("d12", 0, SHEET) + _words("d12", 0, tab, left=580.0, upright=False, first=1000, top=188.0), _words("d12", 1, FLOWS, upright=False)],
    }


DOCUMENTS = _documents()


def statement_words(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([w for pages in DOCUMENTS.values() for words in pages for w in words], WORDS)
