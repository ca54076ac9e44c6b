"""A session that is watched while it runs: frames come as files, events are in the store as soon as they close."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wachter.functions.names import generate_session_id
from wachter.operators import events as ev
from wachter.operators.base import Calibration, split_phases
from wachter.operators.suppression import expand
from wachter.plans.monitor import build_detectors, calibration_row, run_detector
from wachter.sources import SourceError, source_label
from wachter.sources.frames import FrameFileSource
from wachter.sources.store import Store
from wachter.streaming.live import LiveSession, append_readings

#: Seconds before a batch that its windows can look back on.
LOOK_BACK = 4.0


class Watch:
    """config as for monitor(), over a growing frame table (CaptureSource.record() or a capture stream writes one). The calibration takes the first
    frames, which have to be there. Then each batch of new frames is measured with the few seconds before it, and its readings go on to
    the state of the live session: the same events as monitor() finds over the whole table, without clips. A batch that is run again writes
    readings again, whose times the state has already seen and passes over."""

    def __init__(self, spark: SparkSession, config: dict, files_per_batch: int = 1):
        self.spark, self.config, self.files = spark, config, files_per_batch
        self.source = FrameFileSource(config["video_source"]["config"])
        self.store = Store(spark, config["data_dir"])
        self.query: StreamingQuery | None = None

    def _frames(self) -> DataFrame:
        return self.source.frames(self.spark).select(F.lit(self.session_id).alias("session_id"), "*")

    def start(self, seconds: float = 0.0) -> Watch:
        """Calibrates, and begins. seconds: the least time between batches."""
        c, store = self.config, self.store
        self.end = float(c["calibration"]["duration_seconds"])
        self.session_id = generate_session_id(store.names())
        root = f"{store.root}/live/{self.session_id}"
        before, after = split_phases(self._frames(), self.end)
        if after.isEmpty():
            raise SourceError(f"the frames at {self.source.path} don't reach the end of the calibration yet")
        store.create_session(self.session_id, c["session_name"], source_label(c["video_source"]), self.source.fps)

        def kept(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{root}/{name}")
            return self.spark.read.parquet(f"{root}/{name}")

        self.detectors, found = [], []
        for k, d in enumerate(build_detectors(c)):
            cal = d.calibrate(before)
            cal = Calibration(kept(cal.thresholds, f"thresholds-{k}"), kept(cal.baseline, f"baseline-{k}"), cal.annotations, cal.metadata)
            self.detectors.append((d, cal))
            found.append(cal)
        self.thresholds = found[0].thresholds
        for x in found[1:]:
            self.thresholds = self.thresholds.unionByName(x.thresholds)
        notes = found[0].annotations
        for x in found[1:]:
            notes = notes.unionByName(x.annotations)
        store.save_calibration(calibration_row(self.thresholds, notes))
        ids = [r[0] for r in self.thresholds.select("anomaly_id").distinct().collect()]
        self.readings_dir = f"{root}/readings"
        append_readings(self.spark.createDataFrame([], "session_id string, t double, anomaly_id string, intensity double, threshold double, detector string"), self.readings_dir)
        self.live = LiveSession(store, self.session_id, self.readings_dir, expand(c["aggregation"].get("suppresses", {}), ids), ev.Rules.of(c["aggregation"])).start(seconds)
        stream = self.source.stream(self.spark, self.files)
        self.query = stream.writeStream.foreachBatch(self._measure).option("checkpointLocation", f"{root}/checkpoint").trigger(processingTime=f"{seconds} seconds").start()
        return self

    def _measure(self, frames: DataFrame, batch: int) -> None:
        t = F.col("idx") / F.lit(self.source.fps) if self.source.config.get("fps") else F.col("t")
        low, high = frames.select(t.alias("t")).where(F.col("t") >= self.end).agg(F.min("t"), F.max("t")).first()
        if low is None:
            return
        near = self._frames().where((F.col("t") >= low - LOOK_BACK) & (F.col("t") <= high))
        before, after = split_phases(near, self.end)
        parts = [run_detector(d, before, after, cal) for d, cal in self.detectors]
        every = parts[0]
        for x in parts[1:]:
            every = every.unionByName(x)
        new = ev.with_thresholds(every, self.thresholds).where((F.col("t") >= low) & (F.col("t") <= high))
        append_readings(new, self.readings_dir)

    def stop(self) -> str:
        """Works off what has come, closes what is open, and ends the session; returns its id."""
        if self.query is None:
            raise RuntimeError("the session isn't running")
        self.query.processAllAvailable()
        self.query.stop()
        self.query = None
        self.live.stop(time.time())
        return self.session_id
