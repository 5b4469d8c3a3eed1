"""Relational operators: period filters/aggregates, windows, joins, top-k."""

from .enrich import enrich, top_k
from .periods import (activity_partials, churn_period_metrics, current_metrics,
                      expansion_period_metrics, half_open_period, period_over_period,
                      prior_metrics, recent_activity, status_in, trailing_window,
                      usage_trend_60d)
from .pricing import assign_mrr
from .windows import recent_rows, recent_trends, weekly_window_metrics

__all__ = [
    "activity_partials", "assign_mrr", "churn_period_metrics", "current_metrics", "enrich",
    "expansion_period_metrics", "half_open_period", "period_over_period", "prior_metrics",
    "recent_activity", "recent_rows", "recent_trends", "status_in", "top_k", "trailing_window",
    "usage_trend_60d", "weekly_window_metrics",
]
