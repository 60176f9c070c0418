"""Labels and regression targets."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Literals a delimited file uses for a missing cell.
NA_LITERALS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "N/A", "NA", "NULL", "NaN", "nan",
)

# Label to grade; every other label, and none, gets the lowest.
GRADES = {"good": 3, "neutral": 2}
LOWEST_GRADE = 1


def missing(col: Column, literals: Iterable[str] = NA_LITERALS) -> Column:
    return col.isNull() | col.isin(*literals)


def fill_missing(df: DataFrame, text_cols: Iterable[str], literals: Iterable[str] = NA_LITERALS) -> DataFrame:
    """Null and missing-value literals become ``''`` in the text columns; numbers keep their nulls."""
    literals = tuple(literals)
    return df.withColumns(
        {c: F.when(missing(F.col(c), literals), F.lit("")).otherwise(F.col(c)) for c in text_cols}
    )


def grade(label: Column, base: int = 1) -> Column:
    """Grade of a label; ``base`` 1 gives 1-3, ``base`` 0 gives 0-2."""
    if base not in (0, 1):
        raise ValueError("base must be 0 or 1")
    shift = 1 - base
    out = None
    for name, value in GRADES.items():
        step = F.lit(value - shift)
        out = F.when(label == name, step) if out is None else out.when(label == name, step)
    return out.otherwise(F.lit(LOWEST_GRADE - shift))


def target(label: Column, confidence: Column, base: int = 1) -> Column:
    return grade(label, base) * confidence
