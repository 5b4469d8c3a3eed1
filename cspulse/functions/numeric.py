"""Exact numeric expressions (Spark SQL text).

PostgreSQL averages integers as exact NUMERIC and rounds half away from
zero.  Spark's ``avg`` on integers returns a double, whose low bits depend on
the summation order across partitions.  Every average here is therefore an
exact ``sum / count`` in decimal arithmetic, fixed to ``DECIMAL(18,6)`` at
once; ratios are fixed to the same scale before ``round``.  Constants in
threshold products are decimal literals: a double ``1.15 * 100`` is
``114.99999999999999``.

Operands are widened to DECIMAL(20,6), not DECIMAL(38,x): Spark trims the
scale of a quotient to 6 digits when both operands already use 38 digits of
precision, which would round a ratio before it is multiplied by 100.
"""

from __future__ import annotations

AVG_TYPE = "DECIMAL(18,6)"
_OPERAND = "DECIMAL(20,6)"
_SUM = "DECIMAL(38,6)"


def fix6(expr: str) -> str:
    return f"CAST({expr} AS {AVG_TYPE})"


def mean_of(total: str, count: str) -> str:
    """``total / count`` as DECIMAL(18,6); NULL when count is 0 or NULL.

    ``total`` and ``count`` may be partial sums merged across a join, which is
    how row-weighted averages are pre-aggregated before a shuffle.
    """
    return fix6(f"CAST({total} AS {_SUM}) / NULLIF({count}, 0)")


def avg_exact(expr: str) -> str:
    """Aggregate: exact average of an integer/decimal expression (NULLs ignored)."""
    return mean_of(f"SUM({expr})", f"COUNT({expr})")


def pct_change(cur: str, prev: str, guard: str = "positive") -> str:
    """ROUND((cur - prev) / prev * 100, 1).

    guard="positive": NULL unless prev > 0 (trend analysis).
    guard="notnull":  NULL when prev is NULL; prev = 0 also gives NULL
                      where the reference would raise a division error.
    """
    num = f"(CAST({cur} AS {_OPERAND}) - CAST({prev} AS {_OPERAND})) * 100"
    value = f"ROUND({fix6(f'{num} / NULLIF(CAST({prev} AS {_OPERAND}), 0)')}, 1)"
    cond = f"{prev} > 0" if guard == "positive" else f"{prev} IS NOT NULL"
    return f"CASE WHEN {cond} THEN {value} END"


def ratio_pct(part: str, whole: str) -> str:
    """100.0 * part / whole at DECIMAL(18,6), unrounded; NULL if whole = 0."""
    return fix6(f"100.0 * CAST({part} AS {_OPERAND}) / NULLIF(CAST({whole} AS {_OPERAND}), 0)")


def pct_of(part: str, whole: str) -> str:
    """ROUND(100.0 * part / whole, 1)."""
    return f"ROUND({ratio_pct(part, whole)}, 1)"


def round_num(expr: str, scale: int) -> str:
    """ROUND(x, scale) returning a decimal even for integer input.

    PostgreSQL's ROUND(int, n) yields NUMERIC (100 -> 100.0); Spark would keep
    the integer type.
    """
    return f"ROUND(CAST({expr} AS {_OPERAND}), {scale})"
