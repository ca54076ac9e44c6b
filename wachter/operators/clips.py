"""Evidence clips: frames near events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_join(points: DataFrame, spans: DataFrame, keys: list[str], t: str, low: str, high: str, width: float) -> DataFrame:
    """points with the spans of the same keys that their t lies in, ends included. Both meet in buckets of this width, so that it is an
    equi-join; a span is copied once for each bucket that it reaches."""
    e = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    f = points.withColumn("_bucket", F.floor(F.col(t) / width))
    return f.join(e, [*keys, "_bucket"]).where((F.col(t) >= F.col(low)) & (F.col(t) <= F.col(high))).drop("_bucket")


def clip_frames(frames: DataFrame, events: DataFrame, lead: float = 1.0, max_clip: float = 6.0) -> DataFrame:
    """(event columns' keys, idx, t): the frames of each event from lead before its start until it closed, at most lead + max_clip after the
    first of them. Buckets are as long as a clip; frames' pixels are joined on later."""
    span = max(lead + max_clip, 1e-3)
    first = F.col("start") - lead
    e = events.select("session_id", "anomaly_id", "start", first.alias("_a"), F.least(first + span, F.coalesce(F.col("closed_at"), F.lit(float("inf")))).alias("_b"))
    hit = range_join(frames.select("session_id", "idx", "t"), e, ["session_id"], "t", "_a", "_b", span)
    # the clip's own first frame, not the nominal lead, starts its length
    w = Window.partitionBy("session_id", "anomaly_id", "start")
    hit = hit.withColumn("_f", F.min("t").over(w)).where(F.col("t") <= F.col("_f") + lead + max_clip)
    return hit.select("session_id", "anomaly_id", "start", "idx", "t")


def subsample(clips: DataFrame, source_fps: float, target_fps: float, keys: tuple[str, ...] = ("session_id", "anomaly_id", "start")) -> DataFrame:
    """Every n-th frame of each clip, n the rounded (half to even) quotient of the rates, at least 1."""
    stride = max(1, round(source_fps / max(target_fps, 1e-6)))
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("t")) - 1
    return clips.withColumn("_rn", rn).where(F.col("_rn") % stride == 0).drop("_rn")


def calibration_clip(frames: DataFrame, end: float, fps: float, seconds: float = 2.0) -> DataFrame:
    """The last frames up to and with the first that is not of the calibration."""
    upto = frames.where(F.col("t") < end + 1.0 / fps)
    rn = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("t")))
    return upto.withColumn("_rn", rn).where(F.col("_rn") <= int(seconds * fps)).drop("_rn")
