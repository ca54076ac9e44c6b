"""Live event detection: the same rules as wachter.operators.events, reading by reading, as Structured Streaming state by session.

Suppression couples a session's signals, so the state's key is the session. An event row comes out once, when the event closes."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wachter.operators.events import Rules
from wachter.schemas import READINGS
from wachter.sources.store import Store

EVENT = "session_id string, anomaly_id string, detector string, start double, `end` double, duration double, max_intensity double, threshold double, closed_at double, timeline array<struct<t:double,v:double>>"
_STATE = "body string"


class Signals:
    """State of one session. Each signal: run (first and last raw time of its streak) and event (None, or the open one). last: the time up to
    which readings were taken; what comes again is passed over."""

    def __init__(self, rules: Rules, suppressors: dict[str, set[str]], body: str = "{}"):
        self.rules, self.suppressors = rules, suppressors
        state = json.loads(body)
        self.of: dict[str, dict[str, Any]] = state.get("of", {})
        self.last: float | None = state.get("last")

    def dump(self) -> str:
        return json.dumps({"of": self.of, "last": self.last})

    def _grips(self, sup: str, t: float) -> bool:
        run = self.of.get(sup, {}).get("run")
        if not run:
            return False
        return run[1] == t or (run[1] - run[0] >= self.rules.min_duration and t - run[1] <= self.rules.linger)

    def step(self, t: float, readings: list[tuple[str, float, float, str]]) -> Iterator[dict]:
        """One time's readings (anomaly, intensity, threshold, detector); yields the events that it closes."""
        if self.last is not None and t <= self.last:
            return
        self.last = t
        high = {a for a, v, limit, _ in readings if v >= limit}
        for a in high:
            mine = self.of.setdefault(a, {"run": None, "event": None})
            run = mine["run"]
            mine["run"] = [t, t] if run is None or t - run[1] > self.rules.cooldown else [run[0], t]
        for a, v, limit, detector in readings:
            fires = a in high and not any(self._grips(s, t) for s in self.suppressors.get(a, ()))
            event = self.of.get(a, {}).get("event")
            if fires and event is None:
                event = self.of[a]["event"] = {"detector": detector, "start": t, "end": t, "top": v, "threshold": limit, "points": []}
            if event is None:
                continue
            if fires:
                event["end"], event["top"] = t, max(event["top"], v)
            points = event["points"]
            points.append([t, v])
            if len(points) > self.rules.max_points:
                event["points"] = [*points[::2], points[-1]]
            if not fires and t - event["end"] >= self.rules.cooldown:
                yield from self._finish(a, t)

    def flush(self) -> Iterator[dict]:
        for a in list(self.of):
            if self.of[a]["event"]:
                yield from self._finish(a, None)

    def _finish(self, a: str, t: float | None) -> Iterator[dict]:
        e, self.of[a]["event"] = self.of[a]["event"], None
        if e["end"] - e["start"] >= self.rules.min_duration:
            yield {"anomaly_id": a, "detector": e["detector"], "start": e["start"], "end": e["end"], "duration": e["end"] - e["start"], "max_intensity": e["top"], "threshold": e["threshold"], "closed_at": t, "timeline": [{"t": x, "v": v} for x, v in e["points"] if x <= e["end"]]}


def by_target(edges: Iterable[tuple[str, str]]) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for sup, tgt in edges:
        out.setdefault(tgt, set()).add(sup)
    return out


def _rows(session: str, found: Iterable[dict]) -> pd.DataFrame:
    names = [c.split()[0].strip("`") for c in EVENT.split(", ")][:10]
    return pd.DataFrame([{"session_id": session, **e} for e in found], columns=names).astype({"closed_at": "float64"})


def stream_events(readings: DataFrame, edges: Iterable[tuple[str, str]], rules: Rules = Rules(), idle_ms: int | None = None) -> DataFrame:
    """Streaming readings to events. A row whose anomaly_id is null ends its session: open events are flushed. With idle_ms, a session
    without readings for so long is flushed too. Within a batch a session's readings are put in order of time."""
    targets = by_target(edges)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        signals = Signals(rules, targets, state.get[0] if state.exists else "{}")
        found: list[dict] = []
        if state.hasTimedOut:
            found += signals.flush()
            state.remove()
            if found:
                yield _rows(key[0], found)
            return
        got = pd.concat(list(batches), ignore_index=True)
        ended = got["anomaly_id"].isna()
        for t, rows in got[~ended].sort_values(["t", "anomaly_id"], kind="stable").groupby("t", sort=True):
            found += signals.step(float(t), list(rows[["anomaly_id", "intensity", "threshold", "detector"]].itertuples(index=False, name=None)))
        if ended.any():
            found += signals.flush()
        state.update((signals.dump(),))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        if found:
            yield _rows(key[0], found)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return readings.groupBy("session_id").applyInPandasWithState(run, EVENT, _STATE, "append", timeout)


def open_readings(spark: SparkSession, readings_dir: str, files_per_batch: int = 1) -> DataFrame:
    """A folder of reading files as a stream, in the order in which they came."""
    return spark.readStream.schema(READINGS).option("maxFilesPerTrigger", files_per_batch).parquet(readings_dir)


def append_readings(readings: DataFrame, readings_dir: str) -> None:
    """One more file of readings."""
    names = [f.name for f in readings.sparkSession.createDataFrame([], READINGS).schema]
    readings.select(*names).coalesce(1).write.mode("append").parquet(readings_dir)


def end_marks(sessions: DataFrame) -> DataFrame:
    """The rows that end the sessions(session_id) of a stream of readings: their open events are flushed."""
    return sessions.select("session_id").distinct().selectExpr("session_id", "double('inf') as t", "cast(null as string) as anomaly_id", "0D as intensity", "0D as threshold", "'' as detector")


def run_available(readings_dir: str, spark: SparkSession, edges: Iterable[tuple[str, str]], rules: Rules, out: str, checkpoint: str, files_per_batch: int = 1) -> DataFrame:
    """All files of a folder as a stream, batch by batch, to Parquet; returns what came out. Files that arrive later go on from there."""
    src = open_readings(spark, readings_dir, files_per_batch)
    query = stream_events(src, edges, rules).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)


class LiveSession:
    """A session that is watched while it runs: readings come as files of a folder, events go to the store batch by batch as they close. A batch
    that is run again after a failure replaces what it had written. stop() ends the session in order: what has come is worked off, open
    events are closed and stored, and the session is marked as completed."""

    def __init__(self, store: Store, session_id: str, readings_dir: str, edges: Iterable[tuple[str, str]], rules: Rules = Rules(), files_per_batch: int = 4, checkpoint: str | None = None):
        self.store, self.session_id, self.dir = store, session_id, readings_dir
        self.edges, self.rules, self.files = list(edges), rules, files_per_batch
        self.checkpoint = checkpoint or f"{store.root}/checkpoints/{session_id}"
        self.query: StreamingQuery | None = None

    def start(self, seconds: float = 0.0) -> LiveSession:
        """Begins, or goes on where an earlier run ended. seconds: the least time between batches."""

        def keep(events: DataFrame, batch: int) -> None:
            self.store.append_events(events.where(F.col("session_id") == self.session_id), batch)

        found = stream_events(open_readings(self.store.spark, self.dir, self.files), self.edges, self.rules)
        self.query = found.writeStream.outputMode("append").option("checkpointLocation", self.checkpoint).trigger(processingTime=f"{seconds} seconds").foreachBatch(keep).start()
        return self

    def stop(self, finished_at: float | None = None) -> None:
        if self.query is None:
            raise RuntimeError("the session isn't running")
        spark = self.store.spark
        append_readings(end_marks(spark.createDataFrame([(self.session_id,)], "session_id string")), self.dir)
        self.query.processAllAvailable()
        self.query.stop()
        self.query = None
        self.store.close_events(self.session_id)
        self.store.finish_session(self.session_id, finished_at)
