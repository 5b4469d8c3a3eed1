"""Spark SQL expression text helpers.

The analyses build their expressions as Spark SQL text and hand whole
select lists to ``selectExpr`` / ``expr``: Spark parses each expression in
one call, whereas composing the same CASE ladders from Python ``Column``
objects costs one Py4J round trip per node (thousands per query).  The
resulting logical plans are identical.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(value) -> str:
    """SQL literal text for a Python value (decimals stay exact)."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (Decimal, float)):
        text = str(Decimal(str(value)))
        return text if "." in text or "E" in text else text + ".0"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    raise TypeError(f"no SQL literal for {value!r}")


def decimal(value) -> str:
    """Exact decimal literal (``0.5``, ``1.15``), never a double."""
    text = str(Decimal(str(value)))
    return text if "." in text else text + ".0"


def named(expr: str, name: str) -> str:
    return f"{expr} AS {name}"


def col(expr: str, name: str | None = None) -> Column:
    """One parsed Column from SQL text, optionally aliased."""
    return F.expr(named(expr, name) if name else expr)
