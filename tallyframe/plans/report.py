"""Presentation casts shared by the registered queries and their oracles.

Money is computed in DECIMAL end to end and only rounded at the edge:
``CAST(ROUND(x, 2) AS DOUBLE)``.  Decimal rounding is exact in both engines,
so both sides produce the same double.  Ratios are rounded to 6 places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(c: str | Column, name: str | None = None) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col, 2).cast("double")
    return out.alias(name or (c if isinstance(c, str) else "value"))


def ratio(c: str | Column, name: str | None = None, places: int = 6) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    out = F.round(col.cast("double"), places)
    return out.alias(name or (c if isinstance(c, str) else "value"))


def cents(c: str | Column, name: str | None = None) -> Column:
    """A double rounded half-up to cents as ``floor(x * 100 + 0.5) / 100``:
    plain IEEE arithmetic, identical in every engine, where engines' own
    double rounding and double-to-decimal casts can differ at a half cent."""
    col = F.col(c) if isinstance(c, str) else c
    out = F.floor(col.cast("double") * 100 + 0.5) / 100
    return out.alias(name or (c if isinstance(c, str) else "value"))
