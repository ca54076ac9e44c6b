"""Temporal detector: noise, flicker and contrast of whole frames."""

from __future__ import annotations

from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wachter.functions.image import gray
from wachter.functions.thresholds import MAD_TO_SIGMA, robust_thresholds
from wachter.operators.base import Calibration, Detector, no_regions, pixels
from wachter.operators.signals import baseline_std, contrast, flicker

NOISE, FLICKER, CONTRAST = "temporal/noise", "temporal/flicker", "temporal/contrast"
#: Frames of one task; a chunk also gets the frame before its first.
CHUNK = 256


def frame_metrics(frames: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(session_id, idx, t, mean, std, noise). Chunks with a halo of one frame spread a long session over tasks; only they see pixels."""
    part = F.floor(F.col("idx") / chunk)
    f = frames.withColumn("_c", F.explode(F.when(F.pmod(F.col("idx") + 1, F.lit(chunk)) == 0, F.array(part, part + 1)).otherwise(F.array(part))))

    def run(got: pa.Table) -> pa.Table:
        rows = sorted(got.to_pylist(), key=lambda r: r["idx"])
        before, out = None, []
        for r in rows:
            g = gray(pixels(r)).astype(np.float32)
            noise = 0.0
            if before is not None:
                d = g - before
                noise = MAD_TO_SIGMA * float(np.median(np.abs(d - float(d.mean()))))
            before = g
            if r["idx"] // chunk == r["_c"]:
                out.append({"session_id": r["session_id"], "idx": r["idx"], "t": r["t"], "mean": float(g.mean()), "std": float(g.std()), "noise": noise})
        return pa.Table.from_pylist(out, pa.schema([("session_id", pa.string()), ("idx", pa.int64()), ("t", pa.float64()), ("mean", pa.float64()), ("std", pa.float64()), ("noise", pa.float64())]))

    return f.groupBy("session_id", "_c").applyInArrow(run, "session_id string, idx long, t double, mean double, std double, noise double")


class TemporalDetector(Detector):
    name: ClassVar[str] = "temporal"
    #: Fixed values.
    defaults: ClassVar[dict] = {"window_seconds": 0.5, "sigma_k": 8.0, "noise_floor": 3.0, "flicker_floor": 5.0, "contrast_floor": 0.15}

    def calibrate(self, frames: DataFrame) -> Calibration:
        c = self.config
        m = flicker(frame_metrics(frames), float(c["window_seconds"]))
        base = baseline_std(m)
        # the last seconds of the calibration reach into the first windows of the detection, and so does its last frame
        long = contrast(m, base).select("session_id", F.expr(f"stack(3, '{NOISE}', noise, '{FLICKER}', flicker, '{CONTRAST}', contrast) as (anomaly_id, x)"))
        floors = F.when(F.col("anomaly_id") == NOISE, c["noise_floor"]).when(F.col("anomaly_id") == FLICKER, c["flicker_floor"]).otherwise(c["contrast_floor"]).cast("double")
        thr = robust_thresholds(long, ["session_id", "anomaly_id"], "x", c["sigma_k"], floors).withColumn("detector", F.lit(self.name))
        notes = base.select("session_id", F.to_json(F.struct(F.struct("baseline_std").alias("temporal"))).alias("annotations"))
        meta = base.select("session_id", F.lit(CONTRAST).alias("anomaly_id"), F.to_json(F.struct(F.bround("baseline_std", 2).alias("baseline_std"))).alias("metadata"))
        return Calibration(thr.select("session_id", "detector", "anomaly_id", "threshold"), base, notes, meta)

    def detect(self, frames: DataFrame, calibration: Calibration, before: DataFrame | None = None) -> DataFrame:
        """before: the calibration's frames, whose end the first windows still see."""
        every = frames if before is None else before.withColumn("_old", F.lit(True)).unionByName(frames.withColumn("_old", F.lit(False)))
        first = frames.groupBy("session_id").agg(F.min("idx").alias("_first"))
        m = flicker(frame_metrics(every.drop("_old")), float(self.config["window_seconds"])).join(first, "session_id").where("idx >= _first")
        long = contrast(m, calibration.baseline).select("session_id", "t", F.expr(f"stack(3, '{NOISE}', noise, '{FLICKER}', flicker, '{CONTRAST}', contrast) as (anomaly_id, intensity)"))
        return long.withColumn("detector", F.lit(self.name)).withColumn("regions", no_regions())


