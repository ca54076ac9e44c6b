"""What reports show: filters, sorts, listings, plot scales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wachter.functions import text as T

#: The names of the sort orders.
SORTS = {
    "Start time (earliest first)": (F.asc, "start"),
    "Start time (latest first)": (F.desc, "start"),
    "Duration (longest first)": (F.desc, "duration"),
    "Peak intensity (highest first)": (F.desc, "max_intensity"),
}


def filter_events(events: DataFrame, search: str = "", types: Sequence[str] = (), min_duration: float = 0.0, sort: str = "") -> DataFrame:
    """Events of these types (none: all) and at least this duration whose id or detector holds the search text, sorted; unknown orders sort
    by start. Ties keep the order of ids."""
    out = events.where(F.col("duration") >= min_duration)
    if types:
        out = out.where(F.col("anomaly_id").isin(*types))
    if q := (search or "").strip().lower():
        out = out.where(F.lower("anomaly_id").contains(q) | F.lower("detector").contains(q))
    order, column = SORTS.get(sort, (F.asc, "start"))
    return out.orderBy(order(column), *([F.asc("id")] if "id" in events.columns else []))


def event_types(events: DataFrame) -> DataFrame:
    """One row: the sorted types, the number of events, and the top of the duration slider (at least 1)."""
    return events.agg(F.array_sort(F.collect_set("anomaly_id")).alias("types"), F.count("*").alias("n"), F.greatest(F.coalesce(F.max("duration"), F.lit(1.0)), F.lit(1.0)).alias("max_duration"))


def list_sessions(sessions: DataFrame) -> DataFrame:
    """Newest first, with the selector's label."""
    return sessions.withColumn("label", T.session_label(F.col("id"), F.col("name"), F.col("started_at"), F.col("status"))).orderBy(F.desc("started_at"), "id")


def session_overview(sessions: DataFrame, events: DataFrame, calibrations: DataFrame) -> DataFrame:
    """Sessions with their number of events and whether they were calibrated."""
    n = events.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n_events"))
    c = calibrations.select(F.col("session_id").alias("id"), F.lit(True).alias("calibrated"))
    return sessions.join(n, "id", "left").join(c, "id", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0))).withColumn("calibrated", F.coalesce("calibrated", F.lit(False)))


def event_detail(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """What is shown of one event: its fields rounded for reading, when it was by the clock, whether it has evidence."""
    e = events.join(sessions.select(F.col("id").alias("session_id"), "started_at"), "session_id")
    at = lambda c: T.offset_time(F.col("started_at"), F.col(c))
    shown = [F.round(c, 3).alias(c) for c in ("start", "end", "duration", "max_intensity", "threshold")]
    return e.select("session_id", "id", "anomaly_id", "detector", *shown, at("start").alias("started"), at("end").alias("ended"), F.size("timeline").alias("points"), F.col("media").isNotNull().alias("has_media"))


def hud_cards(calibrations: DataFrame) -> DataFrame:
    """The overlay elements that calibrations found: one row each, with its rate (null if it stays on) and the share of time it was seen."""
    shape = "struct<hud_elements:array<struct<box:array<int>,id:string,text:string,blink_hz:double,on_ratio:double>>>"
    e = calibrations.select("session_id", F.explode(F.from_json("annotations", shape)["hud_elements"]).alias("e"))
    title = F.coalesce(F.nullif(F.col("e.text"), F.lit("")), F.col("e.id"))
    return e.select("session_id", F.col("e.id").alias("id"), title.alias("title"), F.nullif(F.round("e.blink_hz", 2), F.lit(0.0)).alias("blink_hz"), "e.box", F.round(F.coalesce("e.on_ratio", F.lit(0.0)) * 100).cast("int").alias("seen_percent"))


def calibration_detail(calibrations: DataFrame) -> DataFrame:
    """One row a session, detector and signal: its threshold."""
    by = calibrations.select("session_id", F.explode("thresholds").alias("detector", "of"))
    return by.select("session_id", "detector", F.explode("of").alias("anomaly_id", "threshold"))


#: Columns of the CSV export.
CSV_COLUMNS = "event_id anomaly_id detector start_s end_s duration_s max_intensity threshold start_time end_time media".split()


def csv_rows(events: DataFrame, sessions: DataFrame) -> DataFrame:
    """The CSV export's rows, all text but the id."""
    e = events.join(sessions.select(F.col("id").alias("session_id"), "started_at"), "session_id")
    f = lambda p, c: F.format_string(p, F.col(c))
    return e.select(
        F.col("id").alias("event_id"), "anomaly_id", "detector", f("%.3f", "start").alias("start_s"), f("%.3f", "end").alias("end_s"), f("%.3f", "duration").alias("duration_s"),
        f("%.6f", "max_intensity").alias("max_intensity"), f("%.6f", "threshold").alias("threshold"), T.offset_time(F.col("started_at"), F.col("start")).alias("start_time"),
        T.offset_time(F.col("started_at"), F.col("end")).alias("end_time"), F.coalesce("media", F.lit("")).alias("media"),
    )


def plot_points(events: DataFrame, width: int = 520, height: int = 200, margin: int = 36) -> DataFrame:
    """Pixels of each event's timeline and threshold line in its plot. An empty timeline is one point, the start at the peak."""
    tl = F.when(F.size("timeline") > 0, F.col("timeline")).otherwise(F.array(F.struct(F.col("start").alias("t"), F.col("max_intensity").alias("v"))))
    e = events.withColumn("tl", tl).withColumn("x0", F.array_min(F.transform("tl", lambda p: p["t"]))).withColumn("x1", F.array_max(F.transform("tl", lambda p: p["t"])))
    e = e.withColumn("x1", F.when(F.col("x1") == F.col("x0"), F.col("x0") + 1).otherwise(F.col("x1")))
    top = F.greatest(F.array_max(F.transform("tl", lambda p: p["v"])), F.col("threshold")) * 1.15
    e = e.withColumn("top", F.when(top == 0, 1.0).otherwise(top))
    y = lambda v: (F.lit(height - margin) - v / F.col("top") * (height - 2 * margin)).cast("int")
    px = F.transform("tl", lambda p: F.struct((F.lit(margin) + (p["t"] - F.col("x0")) / (F.col("x1") - F.col("x0")) * (width - 2 * margin)).cast("int").alias("x"), y(p["v"]).alias("y")))
    return e.withColumn("points", px).withColumn("threshold_y", y(F.col("threshold"))).drop("tl", "x0", "x1", "top")
