"""token-sort similarity (normalised Indel) of cleaned labels, in built-in functions and as an Arrow UDF."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda w: w != "")), " ")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: a dynamic programme over rows kept as arrays."""
    rows = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)))
    cols = F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1)))

    def row(prev: Column, i: Column) -> Column:
        def cell(made: Column, j: Column) -> Column:
            hit = F.get(prev, j - 1) + 1
            miss = F.greatest(F.get(prev, j), F.element_at(made, -1))
            return F.concat(made, F.array(F.when(F.substr(a, i, F.lit(1)) == F.substr(b, j, F.lit(1)), hit).otherwise(miss)))

        return F.aggregate(cols, F.array(F.lit(0)), cell)

    start = F.array_repeat(F.lit(0), F.length(b).cast("int") + 1)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(F.aggregate(rows, start, row), -1))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """200 * LCS / (both lengths) of the space-joined sorted tokens; 100 for two empty texts."""
    x, y = sorted_tokens(a), sorted_tokens(b)
    total = F.length(x) + F.length(y)
    return F.when(total == 0, 100.0).otherwise(200.0 * lcs_length(x, y) / total)


def _lcs(a: str, b: str) -> int:
    """Bit-parallel: one integer holds a whole row of the programme."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def token_sort_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same over Arrow batches: the faster form when there are many labels."""
    x = [" ".join(sorted((t or "").split())) for t in a]
    y = [" ".join(sorted((t or "").split())) for t in b]
    return pd.Series([200.0 * _lcs(p, q) / (len(p) + len(q)) if p or q else 100.0 for p, q in zip(x, y, strict=True)], dtype="float64")
