"""Stored aggregation state: what repeated analyses need, kept per date and refreshed by the dates that changed."""

from .totals import RunningTotals
from .visits import CohortVisits

__all__ = ["CohortVisits", "RunningTotals"]
