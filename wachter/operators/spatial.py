"""Spatial detector: distortion of the background, by tracked corners."""

from __future__ import annotations

from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wachter.functions.image import dilate, good_corners, gray, pyramid, track
from wachter.functions.thresholds import robust_thresholds, with_floor_for_missing
from wachter.operators.base import Calibration, Detector, pixels, stride_sample, with_baseline

DISTORTION = "spatial/distortion"
_LEVELS = 3


class SpatialDetector(Detector):
    name: ClassVar[str] = "spatial"
    #: Fixed values.
    defaults: ClassVar[dict] = {
        "bright_threshold": 220, "exclusion_dilate": 21, "max_corners": 150, "corner_quality": 0.03, "corner_min_distance": 7, "max_baseline_frames": 40,
        "fb_max_error": 1.5, "outlier_rank": 3, "sigma_k": 8.0, "floor": 2.5, "region_size": 28,
    }

    def ever_bright(self, frames: DataFrame) -> DataFrame:
        """(session_id, bright): the pixels that were ever bright, as packed bits; reduced in each task first."""
        level = int(self.config["bright_threshold"])

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[str, np.ndarray] = {}
            for b in batches:
                for r in b.to_pylist():
                    bits = np.packbits(gray(pixels(r)) > level)
                    seen[r["session_id"]] = seen[r["session_id"]] | bits if r["session_id"] in seen else bits
            for s, bits in seen.items():
                yield pa.RecordBatch.from_pydict({"session_id": [s], "bright": [bits.tobytes()]})

        def merge(got: pa.Table) -> pa.Table:
            bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in got.column("bright").to_pylist()])
            return pa.table({"session_id": pa.array([got.column("session_id")[0].as_py()], pa.string()), "bright": pa.array([bits.tobytes()], pa.binary())})

        schema = "session_id string, bright binary"
        return frames.mapInArrow(reduce, schema).groupBy("session_id").applyInArrow(merge, schema)

    def baseline(self, frames: DataFrame) -> DataFrame:
        """(session_id, height, width, base, points): the median image of a bounded sample of frames (fewer than twice max_baseline_frames a
        session), and its corners away from anything bright."""
        c = self.config

        def find(bright: pa.Table, got: pa.Table) -> pa.Table:
            rows = got.to_pylist()
            base = np.median(np.stack([gray(pixels(r)) for r in rows]), axis=0).astype(np.uint8)
            bits = np.frombuffer(bright.column("bright")[0].as_py(), np.uint8)
            free = ~dilate(np.unpackbits(bits, count=base.size).reshape(base.shape).astype(bool), c["exclusion_dilate"])
            p = good_corners(base, c["max_corners"], c["corner_quality"], c["corner_min_distance"], free)
            kinds = pa.schema([("session_id", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("base", pa.binary()), ("points", pa.list_(pa.list_(pa.float64())))])
            return pa.Table.from_pylist([{"session_id": rows[0]["session_id"], "height": base.shape[0], "width": base.shape[1], "base": base.tobytes(), "points": p.tolist()}], kinds)

        sample = stride_sample(frames, int(c["max_baseline_frames"]))
        return self.ever_bright(frames).groupBy("session_id").cogroup(sample.groupBy("session_id")).applyInArrow(find, "session_id string, height int, width int, base binary, points array<array<double>>")

    def displacements(self, frames: DataFrame, baseline: DataFrame) -> DataFrame:
        """(session_id, t, intensity, moved array<struct<x,y,d>>): the outlier_rank-th largest displacement of corners tracked there and back,
        and every corner's."""
        c = self.config
        b = baseline.select("session_id", F.col("height").alias("bh"), F.col("width").alias("bw"), "base", "points")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = pa.schema([("session_id", pa.string()), ("t", pa.float64()), ("intensity", pa.float64()), ("moved", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("d", pa.float64())])))])
            known: tuple[str, list, np.ndarray] | None = None
            for batch in batches:
                out = []
                for r in batch.to_pylist():
                    if known is None or known[0] != r["session_id"]:
                        base = np.frombuffer(r["base"], np.uint8).reshape(r["bh"], r["bw"])
                        known = (r["session_id"], pyramid(base, _LEVELS), np.array(r["points"], float).reshape(-1, 2))
                    _, still, p = known
                    d, ok = np.zeros(len(p)), np.zeros(len(p), bool)
                    if len(p):
                        now = pyramid(gray(pixels(r)), _LEVELS)
                        there, a = track(still, now, p)
                        back, z = track(now, still, there)
                        ok = a & z & (np.hypot(*(back - p).T) < c["fb_max_error"])
                        d = np.where(ok, np.hypot(*(there - p).T), 0.0)
                    k = min(int(c["outlier_rank"]), int(ok.sum()))
                    out.append({"session_id": r["session_id"], "t": r["t"], "intensity": float(np.sort(d)[-max(k, 1)]) if k else 0.0, "moved": [{"x": x, "y": y, "d": v} for (x, y), v in zip(p.tolist(), d.tolist(), strict=True)]})
                yield pa.RecordBatch.from_pylist(out, kinds)

        # a gray image of at most 4K
        f = with_baseline(frames.select("session_id", "idx", "t", "height", "width", "channels", "data"), b, 8 << 20).drop("idx")
        return f.mapInArrow(run, "session_id string, t double, intensity double, moved array<struct<x:double,y:double,d:double>>")

    def calibrate(self, frames: DataFrame) -> Calibration:
        c = self.config
        base = self.baseline(frames)
        jitter = self.displacements(stride_sample(frames, int(c["max_baseline_frames"])), base).select("session_id", F.col("intensity").alias("x"))
        thr = with_floor_for_missing(robust_thresholds(jitter, ["session_id"], "x", c["sigma_k"], c["floor"]), base.select("session_id"), ["session_id"], c["floor"])
        thr = thr.select("session_id", F.lit(self.name).alias("detector"), F.lit(DISTORTION).alias("anomaly_id"), "threshold")
        notes = base.select("session_id", F.to_json(F.struct(F.col("points").alias("keypoints"))).alias("annotations"))
        meta = base.select("session_id", F.lit(DISTORTION).alias("anomaly_id"), F.to_json(F.struct(F.size("points").alias("tracked_points"))).alias("metadata"))
        return Calibration(thr, base.join(thr.select("session_id", "threshold"), "session_id"), notes, meta)

    def detect(self, frames: DataFrame, calibration: Calibration) -> DataFrame:
        """Regions: boxes about the corners that moved at least the threshold."""
        half = int(self.config["region_size"]) // 2
        d = self.displacements(frames, calibration.baseline).join(calibration.baseline.select("session_id", "threshold"), "session_id")
        box = lambda p: F.struct((p["x"].cast("int") - half).alias("x"), (p["y"].cast("int") - half).alias("y"), F.lit(2 * half).alias("w"), F.lit(2 * half).alias("h"))
        boxes = F.transform(F.filter("moved", lambda p: p["d"] >= F.col("threshold")), box)
        return d.select("session_id", "t", F.lit(DISTORTION).alias("anomaly_id"), "intensity", F.lit(self.name).alias("detector"), boxes.alias("regions"))
