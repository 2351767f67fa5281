"""Counters and histograms kept current on streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.operators.reports import DURATION_BOUNDS

# Fixed value: how often the counters are published.
PUBLISH_EVERY = "30 seconds"


def live_counts(rows: DataFrame, *labels: str) -> DataFrame:
    """Running count per lower-cased labels."""
    keys = [F.lower(label).alias(label) for label in labels]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def live_histogram(
    samples: DataFrame, value: str, label: str, bounds: Sequence[float] = DURATION_BOUNDS
) -> DataFrame:
    """Running cumulative buckets, count and sum per label; one state row per label."""
    buckets = [F.count_if(F.col(value) <= b).alias(f"le_{int(b)}") for b in bounds]
    return samples.groupBy(label).agg(
        *buckets, F.count(value).alias("count"), F.sum(value).alias("sum")
    )
