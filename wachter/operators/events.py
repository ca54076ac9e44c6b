"""Readings to events: detection, suppression with linger, episodes with cooldown, timelines.

All state of a frame loop becomes windows by (session, anomaly). Suppression is an as-of look-up of each raw reading's possible
suppressors: only raw readings take part, so no grid of frames and ids is ever built."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    cooldown: float = 1.0
    min_duration: float = 0.5
    linger: float = 2.5
    max_points: int = 2000

    @classmethod
    def of(cls, config: dict) -> Rules:
        get = lambda k, d: type(d)(config.get(k, d))
        return cls(get("cooldown_seconds", cls.cooldown), get("min_duration_seconds", cls.min_duration), get("suppression_linger_seconds", cls.linger), get("max_timeline_points", cls.max_points))


_BY = ["session_id", "anomaly_id"]


def _seq() -> WindowSpec:
    return Window.partitionBy(*_BY).orderBy("t")


def _upto(last: int = 0) -> WindowSpec:
    return _seq().rowsBetween(Window.unboundedPreceding, last)


def with_thresholds(intensities: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds each id's calibrated threshold. An id without one is an error when its row is computed, not a lost row."""
    got = intensities.join(thresholds.select(*_BY, "threshold"), _BY, "left")
    missing = F.raise_error(F.concat(F.lit("no calibrated threshold for "), F.col("anomaly_id"))).cast("double")
    return got.withColumn("threshold", F.coalesce(F.col("threshold"), missing))


def raw(readings: DataFrame) -> DataFrame:
    """Readings that reach their threshold."""
    return readings.where(F.col("intensity") >= F.col("threshold"))


def streaks(readings: DataFrame, cooldown: float) -> DataFrame:
    """Raw readings with streak_start: a gap longer than the cooldown starts a new streak."""
    gap = F.col("t") - F.lag("t").over(_seq())
    starts = F.when(gap.isNull() | (gap > cooldown), F.col("t"))
    return raw(readings).withColumn("streak_start", F.last(starts, ignorenulls=True).over(_upto()))


def suppressed(readings: DataFrame, edges: DataFrame, rules: Rules) -> DataFrame:
    """(session_id, t, anomaly_id) of raw readings that another anomaly suppresses: one that is raw at this time, or was raw for at least
    min_duration and until at most linger ago. Suppressed anomalies suppress too."""
    r = streaks(readings, rules.cooldown)
    probe = r.join(edges, r["anomaly_id"] == edges["tgt"]).select("session_id", "sup", "tgt", "t", F.lit(1).alias("kind"), F.lit(None).cast("struct<t:double,s:double>").alias("up"))
    seen = r.join(edges, r["anomaly_id"] == edges["sup"]).select("session_id", "sup", "tgt", "t", F.lit(0).alias("kind"), F.struct(F.col("t").alias("t"), F.col("streak_start").alias("s")).alias("up"))
    asof = Window.partitionBy("session_id", "sup", "tgt").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    got = probe.union(seen).withColumn("last", F.last("up", ignorenulls=True).over(asof)).where("kind = 1")
    held = (F.col("last.t") == F.col("t")) | ((F.col("last.t") - F.col("last.s") >= rules.min_duration) & (F.col("t") - F.col("last.t") <= rules.linger))
    return got.where(held).select("session_id", "t", F.col("tgt").alias("anomaly_id")).distinct()


def firing(readings: DataFrame, edges: DataFrame | None, rules: Rules) -> DataFrame:
    """readings with fire: raw and not suppressed."""
    up = F.col("intensity") >= F.col("threshold")
    if edges is None:
        return readings.withColumn("fire", F.coalesce(up, F.lit(False)))
    dead = suppressed(readings, edges, rules).withColumn("_dead", F.lit(True))
    return readings.join(dead, ["session_id", "t", "anomaly_id"], "left").withColumn("fire", F.coalesce(up & F.col("_dead").isNull(), F.lit(False))).drop("_dead")


def episodes(fired: DataFrame, cooldown: float) -> DataFrame:
    """Adds episode (0 before the first), last_fire, and open: the episode has not been closed before this reading. An episode closes at a
    reading that doesn't fire, at least the cooldown after the last that did; a gap without readings closes nothing."""
    last_before = F.last(F.when(F.col("fire"), F.col("t")), ignorenulls=True).over(_upto(-1))
    h = fired.withColumn("_lf", last_before).withColumn("_pt", F.lag("t").over(_seq())).withColumn("_pf", F.lag("fire").over(_seq()))
    closed = (~F.col("_pf")) & (F.col("_pt") - F.col("_lf") >= cooldown)
    h = h.withColumn("_new", F.col("fire") & (F.col("_lf").isNull() | closed))
    h = h.withColumn("episode", F.sum(F.col("_new").cast("int")).over(_upto())).withColumn("open", F.col("fire") | (F.col("_lf").isNotNull() & ~F.coalesce(closed, F.lit(False))))
    return h.withColumn("last_fire", F.when(F.col("fire"), F.col("t")).otherwise(F.col("_lf"))).drop("_lf", "_pt", "_pf", "_new")


@lru_cache(4096)
def kept_points(n: int, most: int) -> np.ndarray:
    """Which of n points a timeline holds that has grown under the cap, ascending, some twice: whenever a point makes it longer than that, every
    second point stays and the last once more. It depends on numbers alone, and takes time in proportion to n."""
    kept = np.arange(min(n, most))
    at = len(kept)
    while at < n:
        more = min(max(1, most - len(kept) + 1), n - at)
        kept = np.concatenate([kept, np.arange(at, at + more)])
        at += more
        if len(kept) > most:
            kept = np.append(kept[::2], kept[-1])
    return kept


def _copies(place: Column, n: Column, most: int) -> Column:
    """How often the point at this place (from 1) of n is in the timeline."""

    def count(place: pa.Array, n: pa.Array) -> pa.Array:
        at, of, out = place.to_numpy() - 1, n.to_numpy(), np.ones(len(n), np.int32)
        for m in np.unique(of[of > most]):
            here = of == m
            out[here] = np.bincount(kept_points(int(m), most), minlength=int(m))[at[here]]
        return pa.array(out, pa.int32())

    return F.arrow_udf(count, "int")(place.cast("long"), n.cast("long"))


def capped(points: Column, most: int) -> Column:
    """A whole timeline under the cap."""

    def chosen(n: pa.Array) -> pa.Array:
        return pa.array([kept_points(x, most) for x in n.to_pylist()], pa.list_(pa.int64()))

    return F.transform(F.arrow_udf(chosen, "array<long>")(F.size(points).cast("long")), lambda i: F.get(points, i.cast("int")))


def _timelines(h: DataFrame, rules: Rules) -> DataFrame:
    """(keys, episode, timeline) of open readings. Points beyond the cap are dropped before any list is made: a list never holds more."""
    mine = Window.partitionBy(*_BY, "episode")
    open_ = h.where("open").select(*_BY, "episode", "t", F.col("intensity").alias("v"))
    open_ = open_.withColumn("_i", F.row_number().over(mine.orderBy("t"))).withColumn("_n", F.count("*").over(mine)).withColumn("_m", _copies(F.col("_i"), F.col("_n"), rules.max_points)).where("_m > 0")
    points = F.array_sort(F.collect_list(F.struct("t", "v", "_m")))
    return open_.groupBy(*_BY, "episode").agg(F.flatten(F.transform(points, lambda p: F.array_repeat(F.struct(p["t"].alias("t"), p["v"].alias("v")), p["_m"]))).alias("timeline"))


def detect_events(readings: DataFrame, edges: DataFrame | None, rules: Rules = Rules(), timelines: bool = True) -> DataFrame:
    """(session_id, anomaly_id, detector, start, end, duration, max_intensity, threshold, closed_at[, timeline]): one row an event of at
    least min_duration. threshold and detector are those at the start; the timeline also holds readings that didn't fire, until the end.
    closed_at: the reading that closed it, null if the end of input did."""
    h = episodes(firing(readings, edges, rules), rules.cooldown).where("episode > 0")
    fire = F.col("fire")
    closes = ~fire & F.col("open") & (F.col("t") - F.col("last_fire") >= rules.cooldown)
    ev = h.groupBy(*_BY, "episode").agg(F.min_by("detector", F.when(fire, F.col("t"))).alias("detector"), F.min(F.when(fire, F.col("t"))).alias("start"), F.max(F.when(fire, F.col("t"))).alias("end"), F.max(F.when(fire, F.col("intensity"))).alias("max_intensity"), F.min_by("threshold", F.when(fire, F.col("t"))).alias("threshold"), F.min(F.when(closes, F.col("t"))).alias("closed_at"))
    ev = ev.withColumn("duration", F.col("end") - F.col("start")).where(F.col("duration") >= rules.min_duration)
    if timelines:
        ev = ev.join(_timelines(h, rules), [*_BY, "episode"]).withColumn("timeline", F.filter("timeline", lambda p: p["t"] <= F.col("end")))
    return ev.select(*_BY, "detector", "start", "end", "duration", "max_intensity", "threshold", "closed_at", *(["timeline"] if timelines else []))


def number(events: DataFrame) -> DataFrame:
    """Adds id, by session in the order in which events are finished: by closing time, then those the end of input closed."""
    return events.withColumn("id", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("closed_at").asc_nulls_last(), "start", "anomaly_id")).cast("long"))


def enrich(events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Adds metadata (JSON) and regions as they were at each event's start, from snapshots(session_id, anomaly_id, t, metadata, regions)."""
    s = snapshots.withColumnRenamed("t", "start")
    box = "array<struct<x:int,y:int,w:int,h:int>>"
    return events.join(s, [*_BY, "start"], "left").withColumn("metadata", F.coalesce("metadata", F.lit("{}"))).withColumn("regions", F.coalesce(F.col("regions"), F.array().cast(box)))


def series(events: DataFrame) -> DataFrame:
    """The plot of each event: one row a timeline point, with the threshold."""
    return events.select("session_id", "anomaly_id", "start", "threshold", F.explode("timeline").alias("p")).select("session_id", "anomaly_id", "start", "threshold", F.col("p.t").alias("t"), F.col("p.v").alias("v"))


def peaks(readings: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """The highest intensity by anomaly over a time range."""
    r = readings.where(F.col("t") >= low) if low is not None else readings
    r = r.where(F.col("t") < high) if high is not None else r
    return r.groupBy("session_id", "anomaly_id").agg(F.max("intensity").alias("peak"))
