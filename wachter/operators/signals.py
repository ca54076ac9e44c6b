"""Per-frame signals in built-in functions, for frames small enough to be array columns (session_id, idx, t, px array<double>), and the
windows over scalar signals that all detectors share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wachter.functions.thresholds import MAD_TO_SIGMA


def _order():
    return Window.partitionBy("session_id").orderBy("idx")


def mean_of(px: Column) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda a, x: a + x) / F.size(px)


def median_of(px: Column) -> Column:
    s, n = F.array_sort(px), F.size(px)
    at = lambda i: F.get(s, i.cast("int"))
    return (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2


def frame_stats(frames: DataFrame) -> DataFrame:
    """mean and population std of each frame."""
    f = frames.withColumn("mean", mean_of(F.col("px")))
    return f.withColumn("std", F.sqrt(F.aggregate("px", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("px"))).select("session_id", "idx", "t", "mean", "std")


def frame_noise(frames: DataFrame) -> DataFrame:
    """Robust deviation of the change since the frame before, without its mean; 0 for a session's first frame."""
    f = frames.withColumn("_p", F.lag("px").over(_order())).withColumn("_d", F.zip_with("px", "_p", lambda a, b: a - b))
    f = f.withColumn("_m", mean_of(F.col("_d"))).withColumn("_r", F.transform("_d", lambda d: F.abs(d - F.col("_m"))))
    return f.select("session_id", "idx", "t", F.coalesce(median_of(F.col("_r")) * MAD_TO_SIGMA, F.lit(0.0)).alias("noise"))


def flicker(stats: DataFrame, window: float = 0.5) -> DataFrame:
    """Mean absolute change of the mean from frame to frame over the last seconds; 0 with fewer than two frames. Time differences are compared
    as they are, so that frames just on the limit fall on the same side as in a frame loop."""
    points = F.collect_list(F.struct("t", "mean")).over(_order().rangeBetween(Window.unboundedPreceding, 0)) if window == float("inf") else F.expr(f"collect_list(struct(t, mean)) over (partition by session_id order by t range between {window * 1.0001 + 1e-6!r}D preceding and current row)")
    s = stats.withColumn("_w", points).withColumn("_w", F.filter("_w", lambda p: F.col("t") - p["t"] <= window))
    n = F.size("_w")
    steps = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.abs(F.get("_w", i)["mean"] - F.get("_w", i - 1)["mean"]))
    return s.withColumn("flicker", F.when(n >= 2, F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / (n - 1)).otherwise(0.0)).drop("_w")


def baseline_std(calibration_stats: DataFrame) -> DataFrame:
    """By session the median of std; 1 if that is 0."""
    return calibration_stats.groupBy("session_id").agg(F.coalesce(F.nullif(F.median("std"), F.lit(0.0)), F.lit(1.0)).alias("baseline_std"))


def contrast(stats: DataFrame, baseline: DataFrame) -> DataFrame:
    """Relative deviation of std from the session's baseline."""
    return stats.join(baseline, "session_id").withColumn("contrast", F.abs(F.col("std") / F.col("baseline_std") - 1))


def toggles(visibility: DataFrame, window: float, fill: float, keys: tuple[str, ...] = ("session_id", "element")) -> DataFrame:
    """visibility(keys, t, visible) with rate: changes of visibility per second over the last seconds, and filled: the window spans at least
    this share of its length, with two frames or more."""
    by = ", ".join(keys)
    near = F.expr(f"collect_list(struct(t, visible)) over (partition by {by} order by t range between {window * 1.0001 + 1e-6!r}D preceding and current row)")
    v = visibility.withColumn("_w", near).withColumn("_w", F.filter("_w", lambda p: F.col("t") - p["t"] <= window))
    n, span = F.size("_w"), F.col("t") - F.get("_w", F.lit(0))["t"]
    changes = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: (i < n) & (F.get("_w", i)["visible"] != F.get("_w", i - 1)["visible"])))
    return v.withColumn("rate", F.when(span > 0, changes / span).otherwise(0.0)).withColumn("filled", (n >= 2) & (span >= window * fill)).drop("_w")


def toggle_summary(visibility: DataFrame, keys: tuple[str, ...] = ("session_id", "element")) -> DataFrame:
    """By element the toggle rate over all its frames and the share of visible ones."""
    w = Window.partitionBy(*keys).orderBy("t")
    v = visibility.withColumn("_c", F.coalesce((F.col("visible") != F.lag("visible").over(w)).cast("int"), F.lit(0)))
    return v.groupBy(*keys).agg((F.sum("_c") / F.greatest(F.max("t") - F.min("t"), F.lit(1e-6))).alias("toggle_rate"), F.avg(F.col("visible").cast("int")).alias("on_ratio"))


def kth_largest(values: Column, k: int, n_valid: Column) -> Column:
    """The k-th largest of an array, the last of n_valid if there are fewer; 0 without valid ones."""
    s = F.reverse(F.array_sort(values))
    return F.when(n_valid > 0, F.get(s, F.least(F.lit(k), n_valid) - 1)).otherwise(0.0)


def pixel_max(frames: DataFrame) -> DataFrame:
    """(session_id, pos, top, ever_bright count): each pixel's maximum over time."""
    return frames.select("session_id", F.posexplode("px").alias("pos", "v")).groupBy("session_id", "pos").agg(F.max("v").alias("top"))


def pixel_median(frames: DataFrame) -> DataFrame:
    """Each pixel's median over time."""
    return frames.select("session_id", F.posexplode("px").alias("pos", "v")).groupBy("session_id", "pos").agg(F.median("v").alias("mid"))


def bright_box(frames: DataFrame, width: int, threshold: float) -> DataFrame:
    """Number, centroid and bounding box of each frame's pixels above the threshold; frames without any are left out."""
    p = frames.select("session_id", "idx", F.posexplode("px").alias("pos", "v")).where(F.col("v") > threshold)
    p = p.withColumn("x", F.col("pos") % width).withColumn("y", F.floor(F.col("pos") / width).cast("int"))
    return p.groupBy("session_id", "idx").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
