"""Date expressions: month truncation and PostgreSQL-style AGE month fields.

``EXTRACT(MONTH FROM AGE(a, b))`` is the *month field* of the interval
(0..11, negative when ``a < b``), not the total number of months.  Spark has
no ``age``; ``floor(months_between(a, b))`` differs at month ends (Feb 29 vs
Jan 31 gives 1, AGE gives 0).  The total months are

    t(a, b) = 12 * (year(a) - year(b)) + (month(a) - month(b))
              - (1 if day(a) < day(b) else 0)            for a >= b
    t(a, b) = -t(b, a)                                   for a <  b

and the month field is ``t`` modulo 12 with the sign of ``t``.
"""

from __future__ import annotations


def month_trunc(d: str) -> str:
    """DATE_TRUNC('month', d) as a DATE."""
    return f"trunc({d}, 'MM')"


def _forward_months(a: str, b: str) -> str:
    return (f"((year({a}) - year({b})) * 12 + (month({a}) - month({b}))"
            f" - CASE WHEN dayofmonth({a}) < dayofmonth({b}) THEN 1 ELSE 0 END)")


def age_total_months(a: str, b: str) -> str:
    """Whole months of AGE(a, b), signed."""
    return f"(CASE WHEN {a} >= {b} THEN {_forward_months(a, b)} ELSE -{_forward_months(b, a)} END)"


def age_month_part(a: str, b: str) -> str:
    """EXTRACT(MONTH FROM AGE(a, b)): the 0..11 month field (sign of a - b)."""
    return f"({age_total_months(a, b)} % 12)"
