"""Robust thresholds from calibration samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the MAD of a normal distribution times this is its standard deviation.
MAD_TO_SIGMA = 1.4826
SIGMA_K, FLOOR, HEADROOM = 8.0, 1e-3, 1.5


def robust_thresholds(samples: DataFrame, keys: Sequence[str], value: str = "x", sigma_k: float | Column = SIGMA_K, floor: float | Column = FLOOR, headroom: float | Column = HEADROOM, out: str = "threshold") -> DataFrame:
    """By keys the greatest of floor, median + sigma_k robust deviations, and headroom times the maximum. Exact interpolating medians; a
    group without samples (all null) gets the floor. The median is joined back by key: partial aggregates, no window over all samples."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    mid = samples.groupBy(*keys).agg(F.median(value).alias("_mid"), F.max(value).alias("_max"))
    mad = samples.join(mid.select(*keys, "_mid"), list(keys)).groupBy(*keys).agg(F.median(F.abs(F.col(value) - F.col("_mid"))).alias("_mad"))
    return mid.join(mad, list(keys)).select(*keys, F.greatest(lit(floor), F.col("_mid") + lit(sigma_k) * (F.col("_mad") * MAD_TO_SIGMA), lit(headroom) * F.col("_max")).alias(out))


def with_floor_for_missing(thresholds: DataFrame, ids: DataFrame, keys: Sequence[str], floor: float | Column = FLOOR, out: str = "threshold") -> DataFrame:
    """Adds the ids that no sample mentions, at the floor."""
    f = floor if isinstance(floor, Column) else F.lit(float(floor))
    return ids.join(thresholds, list(keys), "left").withColumn(out, F.coalesce(F.col(out), f))


def robust_threshold(samples: Sequence[float], sigma_k: float = SIGMA_K, floor: float = FLOOR, headroom: float = HEADROOM) -> float:
    """The same for one small sample in a task."""
    import numpy as np

    x = np.asarray(samples, float)
    if not x.size:
        return float(floor)
    mid = np.median(x)
    return float(max(floor, mid + sigma_k * MAD_TO_SIGMA * np.median(np.abs(x - mid)), headroom * x.max()))
