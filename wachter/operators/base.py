"""The detector contract: DataFrames in, DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Calibration:
    """thresholds(session_id, detector, anomaly_id, threshold); baseline: one row a session, of the detector's own; annotations(session_id,
    annotations JSON); metadata(session_id, anomaly_id, metadata JSON)."""

    thresholds: DataFrame
    baseline: DataFrame
    annotations: DataFrame
    metadata: DataFrame


class Detector:
    """A plug-in: defaults overlaid by its configuration. calibrate() takes the frames of the calibration, detect() all later ones and what
    calibrate() found; it returns (session_id, t, anomaly_id, intensity, detector, regions)."""

    name: ClassVar[str] = ""
    defaults: ClassVar[dict] = {}

    def __init__(self, config: dict | None = None):
        self.config = {**self.defaults, **(config or {})}

    def calibrate(self, frames: DataFrame) -> Calibration:
        raise NotImplementedError

    def detect(self, frames: DataFrame, calibration: Calibration) -> DataFrame:
        raise NotImplementedError


#: Bytes of baselines that every task may hold.
LOOKUP_BYTES = 64 << 20


def with_baseline(frames: DataFrame, baseline: DataFrame, row_bytes: int) -> DataFrame:
    """frames with their session's baseline(session_id, ...) of about so many bytes a row. Few sessions are broadcast, after they were counted, so
    that frames stay where they are; many are joined in chunks of a session's frames, so that a session of days is many tasks."""
    if baseline.count() * row_bytes <= LOOKUP_BYTES:
        return frames.join(F.broadcast(baseline), "session_id")
    # each frame goes to one of the copies of its session's row: as many as tasks, not as frames
    n = int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    copies = baseline.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = frames.withColumn("_chunk", F.pmod(F.floor(F.col("idx") / 256), F.lit(n)).cast("int"))
    return dealt.join(copies.hint("shuffle_hash"), ["session_id", "_chunk"]).drop("_chunk")


def pixels(row: dict) -> np.ndarray:
    """The image of a frame's row."""
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])


def no_regions() -> F.Column:
    return F.array().cast("array<struct<x:int,y:int,w:int,h:int>>")


def split_phases(frames: DataFrame, seconds: float) -> tuple[DataFrame, DataFrame]:
    """Calibration frames, and the later ones; the first at the limit is already monitored."""
    return frames.where(F.col("t") < seconds), frames.where(F.col("t") >= seconds)


def limit_frames(frames: DataFrame, most: int | None) -> DataFrame:
    return frames if most is None else frames.where(F.col("idx") < most)


def stride_sample(frames: DataFrame, keep: int) -> DataFrame:
    """Every n-th frame of each session, n so that about keep are left (fewer than twice as many)."""
    n = frames.groupBy("session_id").agg(F.count("*").alias("_n"), F.min("idx").alias("_i"))
    return frames.join(n, "session_id").where(F.pmod(F.col("idx") - F.col("_i"), F.greatest(F.lit(1), F.floor(F.col("_n") / keep))) == 0).drop("_n", "_i")
