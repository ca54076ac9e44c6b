"""Sessions, calibrations and events as Parquet tables.

Sessions are a log of rows whose latest by seq is valid, so that finishing one needs no rewrite; calibrations and events are partitioned
by session, and a session's partition is replaced as a whole: a job that is run again leaves no doubles."""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wachter.operators.events import number
from wachter.operators.report import session_overview
from wachter.schemas import BOX, CALIBRATIONS, EVENTS, SESSIONS

#: Columns of a running session's events: all but the number, and when they closed.
_LIVE = f"{EVENTS.removeprefix('id long, ')}, closed_at double"
_LIVE_COLUMNS = [c.split()[0].strip("`") for c in "session_id, anomaly_id, detector, start, end, duration, max_intensity, threshold, timeline, metadata, regions, media, closed_at".split(", ")]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _read(self, table: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(self._path(table))
        except AnalysisException:
            return self.spark.createDataFrame([], schema)

    def _replace(self, df: DataFrame, table: str) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id").parquet(self._path(table))

    # sessions
    def create_session(self, id_: str, name: str, source: str | None, fps: float | None, started_at: float | None = None) -> None:
        self._log([(id_, name, time.time() if started_at is None else started_at, None, source, fps, "running")])

    def finish_session(self, id_: str, finished_at: float | None = None) -> None:
        done = self.sessions().where(F.col("id") == id_).withColumn("finished_at", F.lit(time.time() if finished_at is None else finished_at)).withColumn("status", F.lit("completed"))
        self._log([tuple(r) for r in done.collect()])

    def _log(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame([(*r, time.time_ns()) for r in rows], SESSIONS + ", seq long").coalesce(1).write.mode("append").parquet(self._path("sessions"))

    def sessions(self) -> DataFrame:
        w = Window.partitionBy("id").orderBy(F.desc("seq"))
        return self._read("sessions", SESSIONS + ", seq long").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "seq")

    def list_sessions(self) -> DataFrame:
        return self.sessions().orderBy(F.desc("started_at"), "id")

    def get_session(self, id_: str) -> DataFrame:
        return self.sessions().where(F.col("id") == id_)

    def names(self) -> set[str]:
        return {r[0] for r in self._read("sessions", SESSIONS + ", seq long").select("id").distinct().collect()}

    # calibrations
    def save_calibration(self, calibration: DataFrame) -> None:
        self._replace(calibration.select(*[f.name for f in self._read("calibrations", CALIBRATIONS).schema]), "calibrations")

    def get_calibration(self, session_id: str) -> DataFrame:
        return self._read("calibrations", CALIBRATIONS).where(F.col("session_id") == session_id)

    # events
    def save_events(self, events: DataFrame) -> None:
        """All events of the sessions in the frame, sorted by start in each session's files."""
        names = [f.name for f in self._read("events", EVENTS).schema]
        self._replace(events.select(*names).repartition("session_id").sortWithinPartitions("session_id", "start"), "events")

    def append_events(self, events: DataFrame, batch: int) -> None:
        """Events that closed in a batch of a running session. The same batch again replaces its rows."""
        new = {"metadata": F.lit("{}"), "regions": F.expr(f"cast(array() as array<{BOX}>)"), "media": F.lit(None).cast("string")}
        live = events.withColumns({c: x for c, x in new.items() if c not in events.columns}).select(*_LIVE_COLUMNS).withColumn("batch", F.lit(batch))
        live.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id", "batch").parquet(self._path("live_events"))

    def _live(self) -> DataFrame:
        """Events of running sessions, numbered in the order in which they closed: a number stays when more come."""
        names = [f.name for f in self._read("events", EVENTS).schema]
        return number(self._read("live_events", f"{_LIVE}, batch long")).select(*names)

    def close_events(self, session_id: str) -> None:
        """A session's live events become its stored ones."""
        self.save_events(self._live().where(F.col("session_id") == session_id))

    def events(self) -> DataFrame:
        """The stored events, and those of sessions that have none stored yet."""
        stored = self._read("events", EVENTS)
        return stored.unionByName(self._live().join(stored.select("session_id").distinct(), "session_id", "left_anti"))

    def list_events(self, session_id: str) -> DataFrame:
        return self.events().where(F.col("session_id") == session_id).orderBy("start", "id")

    def get_event(self, session_id: str, id_: int) -> DataFrame:
        return self.events().where((F.col("session_id") == session_id) & (F.col("id") == id_))

    # reports
    def overview(self) -> DataFrame:
        """Sessions with their number of events and whether they were calibrated."""
        return session_overview(self.sessions(), self.events(), self._read("calibrations", CALIBRATIONS))
