"""Expression building blocks (Spark SQL text): numerics, dates, scoring rules."""

from .dates import age_month_part, age_total_months, month_trunc
from .numeric import AVG_TYPE, avg_exact, mean_of, pct_change, pct_of, ratio_pct, round_num
from .rules import flag, ladder
from .sql import col, decimal, lit, named

__all__ = [
    "AVG_TYPE", "age_month_part", "age_total_months", "avg_exact", "col", "decimal",
    "flag", "ladder", "lit", "mean_of", "month_trunc", "named", "pct_change", "pct_of",
    "ratio_pct", "round_num",
]
