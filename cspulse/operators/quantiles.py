"""Mergeable quantile summaries (KLL sketches) of a measure per group.

A sketch holds some hundreds of values whatever it has seen.  Sketches of parts
(dates, files, partitions) merge into that of the whole, so stored ones answer
for any set of dates without a scan of the rows.  Exact results come from
``ranking.exact_percentiles``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sketch parameter; the rank of a reported value is off by at most RANK_ERROR of the rows, with 99 % confidence.
K, RANK_ERROR = 400, 0.0072


def sketched(df: DataFrame, by: Sequence[str], value: str, k: int = K) -> DataFrame:
    """(by..., values, sketch): a quantile sketch of ``value`` (as double) per group; nulls are left out.

    Partial sketches are made before the shuffle, so a hot group travels as one
    sketch a task.
    """
    return df.where(f"{value} IS NOT NULL").groupBy(*by).agg(
        F.count("*").alias("values"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame, by: Sequence[str], k: int = K) -> DataFrame:
    """Sketches of coarser groups: those of ``by``."""
    return sketches.groupBy(*by).agg(F.sum("values").alias("values"),
                                     F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))


def estimates(sketches: DataFrame, by: Sequence[str], percents: Sequence[int] = (25, 50, 75, 90)) -> DataFrame:
    """(by..., values, p<n>...): estimated percentiles, each a value that was seen."""
    return sketches.select(*by, "values", *(
        F.kll_sketch_get_quantile_double("sketch", F.lit(p / 100)).alias(f"p{p}") for p in percents))
