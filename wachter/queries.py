"""The engine's operators as queries over the driver's tables, each with the same in SQL.

Adapters: readings are the hourly maximum value of each event type (a full grid, 0 where there is none); frames are the embeddings as 8 by 8
pictures, a session for each label at 20 frames a second."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wachter.functions import text as T
from wachter.functions.thresholds import robust_thresholds
from wachter.operators import clips, events, hud, report, signals
from wachter.operators.suppression import edges_of
from wachter.sources.capture import rate_limit
from wachter.sources.synthetic import SCHEDULE, active_at, schedule_table, synthetic_frames
from wachter.streaming import live
from wachter.work import work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Hours of calibration, and the parameters of the flagship query.
CAL_HOURS, SIGMA, HEADROOM, RULES = 240, 3.0, 0.5, events.Rules(2.0, 1.0, 3.0)
EDGES = [("error", "click"), ("error", "view")]
FPS, BRIGHT = 20.0, 0.1


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


# --- readings ---------------------------------------------------------------------------------------


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, t, anomaly_id, intensity): t in hours from the first event's hour."""
    e = read(spark, sf_dir, "events").select(F.expr("unix_micros(cast(ts as timestamp)) div 3600000000").alias("hour"), "event_type", "value")
    top = e.groupBy("hour", "event_type").agg(F.max("value").alias("v"))
    # one row of hours for each type: as many rows as the calendar has, not as there are events
    span = top.groupBy("event_type").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    every = Window.partitionBy(F.lit(0))  # of the few types
    span = span.withColumn("lo", F.min("a").over(every)).withColumn("hi", F.max("b").over(every))
    grid = span.select("event_type", "lo", F.explode(F.sequence("lo", "hi")).alias("hour"))
    full = grid.join(top, ["hour", "event_type"], "left")
    return full.select(F.lit("all").alias("session_id"), (F.col("hour") - F.col("lo")).cast("double").alias("t"), F.col("event_type").alias("anomaly_id"), F.coalesce("v", F.lit(0.0)).alias("intensity"))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hourly(spark, sf_dir)
    thr = robust_thresholds(h.where(F.col("t") < CAL_HOURS), ["session_id", "anomaly_id"], "intensity", SIGMA, 1.0, HEADROOM)
    return events.with_thresholds(h.where(F.col("t") >= CAL_HOURS), thr).withColumn("detector", F.lit("events"))


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "sup string, tgt string")


_HOURLY = """
WITH e AS (SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, event_type, value FROM events),
top AS (SELECT hour, event_type, max(value) AS v FROM e GROUP BY ALL),
span AS (SELECT min(hour) AS lo, max(hour) AS hi FROM top),
grid AS (SELECT y.event_type, lo, unnest(range(lo, hi + 1)) AS hour FROM (SELECT DISTINCT event_type FROM top) y, span),
h AS (SELECT CAST(g.hour - lo AS DOUBLE) AS t, g.event_type AS aid, coalesce(v, 0.0) AS x FROM grid g LEFT JOIN top USING (hour, event_type)),
mid AS (SELECT aid, median(x) AS m, max(x) AS mx FROM h WHERE t < 240 GROUP BY aid),
thr AS (SELECT aid, greatest(1.0, any_value(m) + 3.0 * (median(abs(x - m)) * 1.4826), 0.5 * any_value(mx)) AS threshold FROM h JOIN mid USING (aid) WHERE t < 240 GROUP BY aid),
r AS (SELECT h.t, h.aid, x, threshold, x >= threshold AS raw FROM h JOIN thr USING (aid) WHERE h.t >= 240),
"""
_FIRING = """
r2 AS (SELECT *, last_value(CASE WHEN raw THEN t END IGNORE NULLS) OVER (PARTITION BY aid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_raw FROM r),
r3 AS (SELECT *, last_value(CASE WHEN raw THEN t END IGNORE NULLS) OVER w AS last_raw, last_value(CASE WHEN raw AND (prev_raw IS NULL OR t - prev_raw > 2.0) THEN t END IGNORE NULLS) OVER w AS streak
       FROM r2 WINDOW w AS (PARTITION BY aid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
edge(sup, tgt) AS (VALUES ('error', 'click'), ('error', 'view')),
dead AS (SELECT DISTINCT t, tgt AS aid FROM r3 JOIN edge ON aid = sup WHERE raw OR (last_raw - streak >= 1.0 AND t - last_raw <= 3.0)),
"""
_EPISODES = """
g AS (SELECT *, last_value(CASE WHEN fire THEN t END IGNORE NULLS) OVER (PARTITION BY aid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pf,
       lag(t) OVER (PARTITION BY aid ORDER BY t) AS pt, lag(fire) OVER (PARTITION BY aid ORDER BY t) AS pfire FROM f),
ep AS (SELECT *, sum(CASE WHEN fire AND (pf IS NULL OR (NOT pfire AND pt - pf >= 2.0)) THEN 1 ELSE 0 END) OVER (PARTITION BY aid ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g),
ev AS (SELECT aid, k, min(t) AS s, max(t) AS e, max(x) AS mx, min_by(threshold, t) AS thr FROM ep WHERE fire GROUP BY aid, k HAVING max(t) - min(t) >= 1.0)
"""
_PLAIN = _HOURLY + "f AS (SELECT *, raw AS fire FROM r)," + _EPISODES
_FULL = _HOURLY + _FIRING + "f AS (SELECT r.*, r.raw AND d.aid IS NULL AS fire FROM r LEFT JOIN dead d ON r.t = d.t AND r.aid = d.aid)," + _EPISODES
_EVENT_COLUMNS = 'SELECT aid AS anomaly_id, s AS start_t, e AS end_t, e - s AS duration, round(mx, 6) AS max_intensity, round(thr, 6) AS threshold FROM ev'


def event_columns(e: DataFrame) -> DataFrame:
    return e.select("anomaly_id", F.col("start").alias("start_t"), F.col("end").alias("end_t"), "duration", r6("max_intensity").alias("max_intensity"), r6("threshold").alias("threshold"))


@query(_HOURLY.rstrip().rstrip(",") + " SELECT aid AS anomaly_id, round(threshold, 6) AS threshold FROM thr")
def robust_thresholds_hourly(spark, sf):
    h = hourly(spark, sf).where(F.col("t") < CAL_HOURS)
    return robust_thresholds(h, ["anomaly_id"], "intensity", SIGMA, 1.0, HEADROOM).select("anomaly_id", r6("threshold").alias("threshold"))


@query(_HOURLY.rstrip().rstrip(",") + " SELECT t, aid AS anomaly_id, x AS intensity FROM r WHERE raw")
def raw_detections(spark, sf):
    return events.raw(readings(spark, sf)).select("t", "anomaly_id", "intensity")


@query(_PLAIN + _EVENT_COLUMNS)
def events_cooldown(spark, sf):
    return event_columns(events.detect_events(readings(spark, sf), None, RULES, timelines=False))


@query(_FULL + _EVENT_COLUMNS)
def events_suppressed(spark, sf):
    return event_columns(events.detect_events(readings(spark, sf), edges(spark), RULES, timelines=False))


@query(_FULL + "SELECT ev.aid AS anomaly_id, s AS start_t, count(*) AS n_points, min(t) AS first_t, max(t) AS last_t, round(sum(x), 6) AS total FROM ev JOIN ep ON ev.aid = ep.aid AND ev.k = ep.k AND t <= e GROUP BY ev.aid, s")
def event_timelines(spark, sf):
    p = events.series(events.detect_events(readings(spark, sf), edges(spark), RULES))
    return p.groupBy("anomaly_id", F.col("start").alias("start_t")).agg(F.count("*").alias("n_points"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), r6(F.sum("v")).alias("total"))


@query(_HOURLY + _FIRING.rstrip().rsplit("edge(", 1)[0].rstrip().rstrip(",") + " SELECT aid AS anomaly_id, t, streak AS streak_start, last_raw - streak >= 1.0 AS sustained FROM r3 WHERE raw")
def streaks_sustained(spark, sf):
    return events.streaks(readings(spark, sf), RULES.cooldown).select("anomaly_id", "t", "streak_start", (F.col("t") - F.col("streak_start") >= RULES.min_duration).alias("sustained"))


@query(_HOURLY + _FIRING.rstrip().rstrip(",") + " SELECT d.t, d.aid AS anomaly_id FROM dead d JOIN r ON r.t = d.t AND r.aid = d.aid WHERE r.raw")
def suppressed_readings(spark, sf):
    return events.suppressed(readings(spark, sf), edges(spark), RULES).select("t", "anomaly_id")


@query(_FULL + "SELECT CAST(row_number() OVER (ORDER BY (SELECT min(t) FROM ep WHERE ep.aid = ev.aid AND ep.k = ev.k AND NOT fire AND t > e AND t - e >= 2.0) NULLS LAST, s, aid) AS BIGINT) AS id, aid AS anomaly_id, s AS start_t FROM ev")
def event_ids(spark, sf):
    return events.number(events.detect_events(readings(spark, sf), edges(spark), RULES, timelines=False)).select("id", "anomaly_id", F.col("start").alias("start_t"))


@query(_HOURLY.rstrip().rstrip(",") + " SELECT aid AS anomaly_id, max(x) AS peak FROM r WHERE t < 480 GROUP BY aid")
def reading_peaks(spark, sf):
    return events.peaks(readings(spark, sf), CAL_HOURS, 480).select("anomaly_id", "peak")


# --- suppression rules ------------------------------------------------------------------------------

RULE_ROWS = [("temporal/flicker", "*"), ("temporal/noise", "temporal/contrast"), ("temporal/noise", "hud/*"), ("temporal/noise", "spatial/*"), ("hud/*/size", "hud/*/text"), ("hud/*/size", "hud/*/position"), ("hud/*/position", "hud/*/text")]
IDS = ["temporal/noise", "temporal/flicker", "temporal/contrast", "hud/a/size", "hud/a/text", "hud/a/position", "hud/b/size", "hud/b/text", "spatial/distortion"]
_values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


@query(f"""
WITH ids(i) AS (VALUES {_values([(i,) for i in IDS])}), rules(l, r) AS (VALUES {_values(RULE_ROWS)}),
x AS (SELECT *, length(l) - length(replace(l, '*', '')) AS ls, length(r) - length(replace(r, '*', '')) AS rs, '^' || replace(l, '*', '(.+)') || '$' AS lre, '^' || replace(r, '*', '(.+)') || '$' AS rre FROM rules),
s AS (SELECT x.*, i AS sup FROM ids JOIN x ON regexp_matches(i, lre))
SELECT DISTINCT sup, i AS tgt FROM s JOIN ids ON CASE WHEN ls > 0 AND ls = rs THEN regexp_replace(sup, lre, replace(r, '*', '\\1')) = i ELSE regexp_matches(i, rre) END WHERE sup <> i
""")
def suppression_edges(spark, sf):
    return edges_of(spark.createDataFrame([(i,) for i in IDS], "anomaly_id string"), spark.createDataFrame(RULE_ROWS, "left string, right string"))


# --- frames -----------------------------------------------------------------------------------------


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("string").alias("session_id"), idx.cast("long").alias("idx"), (idx / F.lit(FPS)).alias("t"), F.col("embedding").cast("array<double>").alias("px"))


_FRAMES = """
WITH fr AS (SELECT CAST(label AS VARCHAR) AS session_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS idx, CAST(embedding AS DOUBLE[]) AS px FROM embeddings),
fs AS (SELECT session_id, idx, idx / 20.0 AS t, list_avg(px) AS mean, list_stddev_pop(px) AS std FROM fr),
"""
_NOISE = """
lagged AS (SELECT session_id, idx, px, lag(px) OVER (PARTITION BY session_id ORDER BY idx) AS p FROM fr),
d AS (SELECT session_id, idx, CASE WHEN p IS NOT NULL THEN list_transform(list_zip(px, p), lambda z: z[1] - z[2]) END AS d FROM lagged),
nz AS (SELECT session_id, idx, coalesce(1.4826 * list_median(list_transform(d, lambda v: abs(v - list_avg(d)))), 0.0) AS noise FROM d),
"""
_FLICKER = """
fl AS (SELECT a.session_id, a.idx, a.t, a.std, coalesce(avg(abs(b.mean - c.mean)), 0.0) AS flicker FROM fs a
  LEFT JOIN fs b ON a.session_id = b.session_id AND b.idx <= a.idx AND a.t - b.t <= 0.5
  LEFT JOIN fs c ON c.session_id = b.session_id AND c.idx = b.idx - 1 AND a.t - c.t <= 0.5 GROUP BY ALL),
"""
_CONTRAST = """
half AS (SELECT session_id, count(*) / 2 AS h FROM fr GROUP BY 1),
bs AS (SELECT session_id, coalesce(nullif(median(std), 0), 1.0) AS b FROM fs JOIN half USING (session_id) WHERE idx < h GROUP BY 1),
"""
_end = lambda s: s.rstrip().rstrip(",")


def halves(f: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each session's first half is its calibration."""
    h = f.groupBy("session_id").agg((F.count("*") / 2).alias("h"))
    j = f.join(h, "session_id")
    return j.where(F.col("idx") < F.col("h")).drop("h"), j.where(F.col("idx") >= F.col("h")).drop("h")


@query(_end(_FRAMES) + " SELECT session_id, idx, round(mean, 6) AS mean, round(std, 6) AS std FROM fs")
def frame_stats(spark, sf):
    return signals.frame_stats(frames(spark, sf)).select("session_id", "idx", r6("mean").alias("mean"), r6("std").alias("std"))


@query(_FRAMES + _end(_NOISE) + " SELECT session_id, idx, round(noise, 6) AS noise FROM nz")
def frame_noise(spark, sf):
    return signals.frame_noise(frames(spark, sf)).select("session_id", "idx", r6("noise").alias("noise"))


@query(_FRAMES + _end(_FLICKER) + " SELECT session_id, idx, round(flicker, 6) AS flicker FROM fl")
def frame_flicker(spark, sf):
    return signals.flicker(signals.frame_stats(frames(spark, sf)), 0.5).select("session_id", "idx", r6("flicker").alias("flicker"))


@query(_FRAMES + _end(_CONTRAST) + " SELECT session_id, idx, round(abs(std / b - 1), 6) AS contrast FROM fs JOIN bs USING (session_id)")
def frame_contrast(spark, sf):
    s = signals.frame_stats(frames(spark, sf))
    return signals.contrast(s, signals.baseline_std(halves(s)[0])).select("session_id", "idx", r6("contrast").alias("contrast"))


_SIGNALS = _FRAMES + _NOISE + _FLICKER + _CONTRAST + """
sig AS (SELECT session_id, idx, unnest(['contrast', 'flicker', 'noise']) AS signal, unnest([abs(std / b - 1), flicker, noise]) AS x FROM fl JOIN nz USING (session_id, idx) JOIN bs USING (session_id)),
cal AS (SELECT sig.* FROM sig JOIN half USING (session_id) WHERE idx < h),
sm AS (SELECT session_id, signal, median(x) AS m, max(x) AS mx FROM cal GROUP BY ALL),
st AS (SELECT session_id, signal, greatest(any_value(CASE signal WHEN 'contrast' THEN 0.15 ELSE 0.02 END), any_value(m) + 3.0 * (median(abs(x - m)) * 1.4826), 0.9 * any_value(mx)) AS threshold FROM cal JOIN sm USING (session_id, signal) GROUP BY ALL),
"""


def signal_rows(f: DataFrame) -> DataFrame:
    s = signals.flicker(signals.frame_stats(f), 0.5)
    c = signals.contrast(s, signals.baseline_std(halves(s)[0])).join(signals.frame_noise(f).select("session_id", "idx", "noise"), ["session_id", "idx"])
    return c.select("session_id", "idx", "t", F.expr("stack(3, 'contrast', contrast, 'flicker', flicker, 'noise', noise) as (signal, x)"))


def signal_thresholds(rows: DataFrame) -> DataFrame:
    return robust_thresholds(halves_of(rows)[0], ["session_id", "signal"], "x", SIGMA, F.when(F.col("signal") == "contrast", 0.15).otherwise(0.02), 0.9)


def halves_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    h = rows.groupBy("session_id").agg((F.countDistinct("idx") / 2).alias("h"))
    j = rows.join(h, "session_id")
    return j.where("idx < h").drop("h"), j.where("idx >= h").drop("h")


@query(_end(_SIGNALS) + " SELECT session_id, signal, round(threshold, 6) AS threshold FROM st")
def temporal_thresholds(spark, sf):
    return signal_thresholds(signal_rows(frames(spark, sf))).select("session_id", "signal", r6("threshold").alias("threshold"))


@query(_end(_SIGNALS) + " SELECT session_id, idx, signal, round(x, 6) AS x FROM sig JOIN half USING (session_id) JOIN st USING (session_id, signal) WHERE idx >= h AND x >= threshold")
def temporal_detections(spark, sf):
    rows = signal_rows(frames(spark, sf))
    r = halves_of(rows)[1].join(signal_thresholds(rows), ["session_id", "signal"])
    return r.where("x >= threshold").select("session_id", "idx", "signal", r6("x").alias("x"))


_PIXELS = _end(_FRAMES) + ", px AS (SELECT session_id, idx, unnest(range(len(px))) AS pos, unnest(px) AS v FROM fr) "


@query(_PIXELS + "SELECT session_id, CAST(pos AS INT) AS pos, round(max(v), 6) AS top, bool_or(v > 0.1) AS ever_bright FROM px GROUP BY ALL")
def pixel_max_union(spark, sf):
    return signals.pixel_max(frames(spark, sf)).select("session_id", "pos", r6("top").alias("top"), (F.col("top") > BRIGHT).alias("ever_bright"))


@query(_PIXELS + ", n AS (SELECT session_id, greatest(1, count(*) // 40) AS k FROM fr GROUP BY 1) SELECT session_id, CAST(pos AS INT) AS pos, round(median(v), 6) AS mid FROM px JOIN n USING (session_id) WHERE idx % k = 0 GROUP BY ALL")
def pixel_median_baseline(spark, sf):
    from wachter.operators.base import stride_sample

    return signals.pixel_median(stride_sample(frames(spark, sf), 40)).select("session_id", "pos", r6("mid").alias("mid"))


_BOXES = _PIXELS + ", b AS (SELECT session_id, idx, count(*) AS n, avg(pos % 8) AS cx, avg(pos // 8) AS cy, min(pos % 8) AS x, min(pos // 8) AS y, max(pos % 8) - min(pos % 8) + 1 AS w, max(pos // 8) - min(pos // 8) + 1 AS h FROM px WHERE v > 0.1 GROUP BY ALL) "


@query(_BOXES + "SELECT session_id, idx, n, round(cx, 6) AS cx, round(cy, 6) AS cy, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(w AS INT) AS w, CAST(h AS INT) AS h FROM b")
def bright_boxes(spark, sf):
    return signals.bright_box(frames(spark, sf), 8, BRIGHT).select("session_id", "idx", "n", r6("cx").alias("cx"), r6("cy").alias("cy"), "x", "y", "w", "h")


@query(_BOXES + """, f0 AS (SELECT session_id, cx AS bx0, cy AS by0, w * h AS area FROM b WHERE idx = 0)
SELECT session_id, idx, round(sqrt((cx - bx0) * (cx - bx0) + (cy - by0) * (cy - by0)), 6) AS position, round(abs(w * h / area - 1), 6) AS size FROM b JOIN f0 USING (session_id)""")
def position_and_size(spark, sf):
    b = signals.bright_box(frames(spark, sf), 8, BRIGHT)
    f0 = b.where("idx = 0").select("session_id", F.col("cx").alias("bx"), F.col("cy").alias("by"), (F.col("w") * F.col("h")).alias("area"))
    return b.join(f0, "session_id").select("session_id", "idx", r6(F.hypot(F.col("cx") - F.col("bx"), F.col("cy") - F.col("by"))).alias("position"), r6(F.abs(F.col("w") * F.col("h") / F.col("area") - 1)).alias("size"))


@query(_PIXELS + """, base AS (SELECT session_id, pos, v AS b FROM px WHERE idx = 0), d AS (SELECT session_id, idx, abs(v - b) AS d FROM px JOIN base USING (session_id, pos)),
k AS (SELECT *, row_number() OVER (PARTITION BY session_id, idx ORDER BY CASE WHEN d < 0.3 THEN d ELSE 0 END DESC) AS rn, sum(CASE WHEN d < 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, idx) AS nv FROM d)
SELECT session_id, idx, round(CASE WHEN max(nv) = 0 THEN 0 ELSE max(CASE WHEN rn = least(3, nv) THEN CASE WHEN d < 0.3 THEN d ELSE 0 END END) END, 6) AS displacement FROM k GROUP BY ALL""")
def displacement_rank(spark, sf):
    f = frames(spark, sf)
    first = f.where("idx = 0").select("session_id", F.col("px").alias("b"))
    d = f.join(first, "session_id").withColumn("d", F.zip_with("px", "b", lambda x, y: F.abs(x - y)))
    valid = F.filter("d", lambda x: x < 0.3)
    kept = F.transform("d", lambda x: F.when(x < 0.3, x).otherwise(0.0))
    return d.select("session_id", "idx", r6(signals.kth_largest(kept, 3, F.size(valid))).alias("displacement"))


# --- visibility -------------------------------------------------------------------------------------


@query("""WITH v AS (SELECT conv_id, turn, role = 'user' AS visible, lag(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT DISTINCT ON (conv_id, turn) * FROM conversations ORDER BY conv_id, turn, role))
SELECT conv_id, round(sum(CASE WHEN visible <> p THEN 1 ELSE 0 END) / greatest(max(turn) - min(turn), 1e-6), 6) AS toggle_rate, round(avg(CASE WHEN visible THEN 1.0 ELSE 0.0 END), 6) AS on_ratio FROM v GROUP BY conv_id""")
def toggle_rate(spark, sf):
    v = _visibility(read(spark, sf, "conversations"))
    return signals.toggle_summary(v, ("conv_id",)).select("conv_id", r6("toggle_rate").alias("toggle_rate"), r6("on_ratio").alias("on_ratio"))


def _visibility(c: DataFrame) -> DataFrame:
    return c.groupBy("conv_id", F.col("turn").cast("double").alias("t")).agg((F.min("role") == "user").alias("visible"))


@query("""WITH v AS (SELECT conv_id, turn AS t, min(role) = 'user' AS visible FROM conversations GROUP BY ALL),
w AS (SELECT a.conv_id, a.t, a.t - min(b.t) AS span, count(*) AS n, sum(CASE WHEN b.visible <> c.visible THEN 1 ELSE 0 END) AS k FROM v a JOIN v b ON a.conv_id = b.conv_id AND b.t <= a.t AND a.t - b.t <= 3
  LEFT JOIN v c ON c.conv_id = b.conv_id AND c.t = (SELECT max(t) FROM v d WHERE d.conv_id = b.conv_id AND d.t < b.t AND a.t - d.t <= 3) GROUP BY a.conv_id, a.t)
SELECT conv_id, CAST(t AS DOUBLE) AS t, round(CASE WHEN span > 0 THEN k / span ELSE 0 END, 6) AS rate, n >= 2 AND span >= 3 * 0.9 AS filled FROM w""")
def toggle_windows(spark, sf):
    v = signals.toggles(_visibility(read(spark, sf, "conversations")), 3.0, 0.9, ("conv_id",))
    return v.select("conv_id", "t", r6("rate").alias("rate"), "filled")


# --- text -------------------------------------------------------------------------------------------


@query("SELECT p_partkey, regexp_replace(lower(p_name || ' ' || p_brand), '[^a-z0-9]', '', 'g') AS slug, translate(upper(p_name), 'OI', '01') AS canonical FROM part")
def slugify_ids(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.slugify(F.concat_ws(" ", "p_name", "p_brand")).alias("slug"), T.canonical(F.upper("p_name")).alias("canonical"))


@query("SELECT p_partkey, round(CASE WHEN p_name = p_type THEN 0.0 WHEN p_name = '' OR p_type = '' THEN 1.0 ELSE levenshtein(p_name, p_type) / greatest(length(p_name), length(p_type)) END, 6) AS distance FROM part")
def text_distance(spark, sf):
    return read(spark, sf, "part").select("p_partkey", r6(T.text_distance(F.col("p_name"), F.col("p_type"))).alias("distance"))


@query("SELECT p_partkey, 'hud/' || regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') || '/text' AS anomaly_id, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS element FROM part")
def element_of_id(spark, sf):
    a = read(spark, sf, "part").select("p_partkey", F.concat_ws("/", F.lit("hud"), T.element_id(F.col("p_brand"), F.lit(1), F.lit(2)), F.lit("text")).alias("anomaly_id"))
    return a.withColumn("element", T.hud_element_of(F.col("anomaly_id")))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_roundtrip(spark, sf):
    e = read(spark, sf, "events").select("event_id", F.from_json("props", "map<string,bigint>").alias("m"))
    return e.select("event_id", F.from_json(F.to_json("m"), "struct<k:bigint>")["k"].alias("k"))


# --- clips ------------------------------------------------------------------------------------------


@query(_FULL + """, fr AS (SELECT DISTINCT t FROM r), hit AS (SELECT aid, s, t, min(t) OVER (PARTITION BY aid, s) AS f FROM ev JOIN fr ON t >= s - 1 AND t <= s + 6
  AND t <= coalesce((SELECT min(q.t) FROM ep q WHERE q.aid = ev.aid AND q.k = ev.k AND NOT fire AND q.t > e AND q.t - e >= 2.0), 'inf'::DOUBLE)),
n AS (SELECT *, row_number() OVER (PARTITION BY aid, s ORDER BY t) - 1 AS rn FROM hit WHERE t <= f + 7)
SELECT aid AS anomaly_id, s AS start_t, t FROM n WHERE rn % 2 = 0""")
def clip_frames(spark, sf):
    r = readings(spark, sf)
    ev = events.detect_events(r, edges(spark), RULES, timelines=False)
    f = r.select("session_id", "t").distinct().withColumn("idx", F.col("t").cast("long"))
    return clips.subsample(clips.clip_frames(f, ev, 1.0, 6.0), 20.0, 10.0).select("anomaly_id", F.col("start").alias("start_t"), "t")


@query("""SELECT o.o_orderkey, p.o_orderkey AS other, CAST(date_diff('day', o.o_orderdate, p.o_orderdate) AS INT) AS days FROM orders o JOIN orders p ON o.o_custkey = p.o_custkey
WHERE p.o_orderdate >= o.o_orderdate - INTERVAL 1 DAY AND p.o_orderdate <= o.o_orderdate + INTERVAL 30 DAY AND o.o_orderkey <> p.o_orderkey""")
def interval_join(spark, sf):
    """Each order's others of the same customer from a day before to thirty days after it."""
    day = F.datediff(F.col("o_orderdate"), F.lit("1970-01-01"))
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", day.alias("day"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 8.64e10).alias("t"))
    spans = o.select("o_custkey", "o_orderkey", "day", (F.col("t") - 1).alias("a"), (F.col("t") + 30).alias("b"))
    points = o.select("o_custkey", F.col("o_orderkey").alias("other"), F.col("day").alias("other_day"), "t")
    j = clips.range_join(points, spans, ["o_custkey"], "t", "a", "b", 31.0).where("o_orderkey <> other")
    return j.select("o_orderkey", "other", (F.col("other_day") - F.col("day")).alias("days"))


_SCHED = ", ".join(f"('{k}', {a}, {b})" for k, a, b, _ in SCHEDULE)


@query(f"WITH s(key, a, b) AS (VALUES {_SCHED}), fr AS (SELECT unnest(range(1720)) AS idx) SELECT idx, key FROM fr JOIN s ON idx / 20.0 >= a AND idx / 20.0 < b")
def schedule_lookup(spark, sf):
    f = spark.range(1720).select(F.col("id").alias("idx"), (F.col("id") / 20.0).alias("t"))
    return active_at(f, schedule_table(spark)).select("idx", "key")


# --- enrichment, report, export ---------------------------------------------------------------------


@query(_FULL + "SELECT aid AS anomaly_id, s AS start_t, CASE WHEN aid = 'error' THEN 'errors' ELSE '' END AS label, coalesce(CAST(floor(x) AS BIGINT), -1) AS at_open FROM ev JOIN (SELECT t AS t2, aid AS a2, x FROM r) q ON q.a2 = aid AND q.t2 = s")
def event_enrichment(spark, sf):
    r = readings(spark, sf)
    ev = events.detect_events(r, edges(spark), RULES, timelines=False)
    box = "array<struct<x:int,y:int,w:int,h:int>>"
    snap = r.select("session_id", "anomaly_id", "t", F.to_json(F.struct(F.floor("intensity").alias("v"), F.when(F.col("anomaly_id") == "error", "errors").alias("label"))).alias("metadata"), F.array().cast(box).alias("regions"))
    m = F.from_json("metadata", "struct<v:bigint,label:string>")
    return events.enrich(ev, snap).select("anomaly_id", F.col("start").alias("start_t"), F.coalesce(m["label"], F.lit("")).alias("label"), F.coalesce(m["v"], F.lit(-1)).alias("at_open"))


def stored_events(spark, sf) -> DataFrame:
    return events.number(events.detect_events(readings(spark, sf), edges(spark), events.Rules(2.0, 0.0, 3.0))).withColumn("media", F.lit(None).cast("string"))


_STORED = _FULL.replace(">= 1.0 AND t - last_raw", ">= 0.0 AND t - last_raw").replace(">= 1.0)\n", ">= 0.0)\n")


@query(_STORED + "SELECT aid AS anomaly_id, s AS start_t, e - s AS duration FROM ev WHERE e - s >= 0 AND contains(lower(aid), 'c') AND aid IN ('click', 'purchase', 'error')")
def report_filter(spark, sf):
    e = report.filter_events(stored_events(spark, sf), " C ", ["click", "purchase", "error"], 0.0, "Duration (longest first)")
    return e.select("anomaly_id", F.col("start").alias("start_t"), "duration")


@query(_STORED + "SELECT list_sort(list(DISTINCT aid)) AS types, count(*) AS n, greatest(max(e - s), 1.0) AS max_duration FROM ev")
def report_types(spark, sf):
    return report.event_types(stored_events(spark, sf))


#: Events with closing times, numbered as they are finished.
_NUMBERED = _STORED + """, cl AS (SELECT ev.*, (SELECT min(q.t) FROM ep q WHERE q.aid = ev.aid AND q.k = ev.k AND NOT fire AND q.t > e AND q.t - e >= 2.0) AS closed FROM ev),
nr AS (SELECT *, row_number() OVER (ORDER BY closed NULLS LAST, s, aid) AS id FROM cl)
"""
_CLOCK = "strftime(make_timestamp(CAST(floor((1700000000 + {}) * 1000000) AS BIGINT)), '%Y-%m-%d %H:%M:%S')"


@query(_NUMBERED + f"SELECT id AS event_id, aid AS anomaly_id, 'events' AS detector, printf('%.3f', s) AS start_s, printf('%.3f', e) AS end_s, printf('%.3f', e - s) AS duration_s, printf('%.6f', mx) AS max_intensity, printf('%.6f', thr) AS threshold, {_CLOCK.format('s')} AS start_time, {_CLOCK.format('e')} AS end_time, '' AS media FROM nr")
def csv_rows(spark, sf):
    s = spark.createDataFrame([("all", 1.7e9)], "id string, started_at double")
    return report.csv_rows(stored_events(spark, sf), s)


@query(_NUMBERED + f"SELECT id, aid AS anomaly_id, round(s, 3) AS start_t, round(e, 3) AS end_t, round(mx, 3) AS max_intensity, {_CLOCK.format('s')} AS started, {_CLOCK.format('e')} AS ended, (SELECT CAST(count(*) AS INT) FROM ep WHERE ep.aid = nr.aid AND ep.k = nr.k AND t <= e) AS points FROM nr")
def event_detail(spark, sf):
    s = spark.createDataFrame([("all", 1.7e9)], "id string, started_at double")
    return report.event_detail(stored_events(spark, sf), s).select("id", "anomaly_id", F.col("start").alias("start_t"), F.col("end").alias("end_t"), "max_intensity", "started", "ended", "points")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_events, c_acctbal > 0 AS calibrated FROM customer")
def session_overview(spark, sf):
    c = read(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), "c_acctbal")
    e = read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("session_id"))
    return report.session_overview(c, e, c.where("c_acctbal > 0").select(F.col("id").alias("session_id"))).select("id", "n_events", "calibrated")


@query(_HOURLY.rstrip().rstrip(",") + " SELECT 'events' AS detector, aid AS anomaly_id, round(threshold, 6) AS threshold FROM thr")
def calibration_detail(spark, sf):
    h = hourly(spark, sf).where(F.col("t") < CAL_HOURS)
    thr = robust_thresholds(h, ["session_id", "anomaly_id"], "intensity", SIGMA, 1.0, HEADROOM)
    by = thr.groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("anomaly_id", "threshold"))).alias("m")).select("session_id", F.create_map(F.lit("events"), "m").alias("thresholds"))
    return report.calibration_detail(by).select("detector", "anomaly_id", r6("threshold").alias("threshold"))


@query("SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;') AS escaped FROM documents")
def escaped_text(spark, sf):
    return read(spark, sf, "documents").select("doc_id", T.html_escape(F.col("text")).alias("escaped"))


@query(r"""SELECT page_id, len(list_filter(regexp_extract_all(html, '(?:src|href)\s*=\s*["''](https?://[^"'']+)["'']', 1), lambda u: NOT regexp_matches(u, '^https?://(localhost|127\.0\.0\.1)(:|/|$)'))) AS n FROM pages""")
def external_urls(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.size(T.external_urls(F.col("html"))).alias("n"))


@query("SELECT p_partkey, 'data:image/' || CASE WHEN p_partkey % 2 = 0 THEN 'gif' ELSE 'png' END || ';base64,' || to_base64(encode(p_name)) AS uri FROM part")
def data_uris(spark, sf):
    return read(spark, sf, "part").select("p_partkey", T.data_uri(F.col("p_name").cast("binary"), F.when(F.col("p_partkey") % 2 == 0, "a.GIF").otherwise("a.png")).alias("uri"))


@query("SELECT idx, (CAST(trunc(idx / 20.0 * 2 * 2) AS BIGINT) % 2) = 0 AS visible FROM (SELECT unnest(range(1720)) AS idx)")
def square_wave(spark, sf):
    return spark.range(1720).select(F.col("id").alias("idx"), T.square_wave(F.col("id") / 20.0, F.lit(2.0)).alias("visible"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) || CASE WHEN c_name <> CAST(o_orderkey AS VARCHAR) THEN ' (' || c_name || ')' ELSE '' END || ' · ' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || CASE WHEN o_orderstatus = 'F' THEN '' ELSE ' [running]' END AS label
FROM orders JOIN customer ON o_custkey = c_custkey""")
def session_list(spark, sf):
    o = read(spark, sf, "orders").join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    s = o.select(F.col("o_orderkey").cast("string").alias("id"), F.col("c_name").alias("name"), (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1e6).alias("started_at"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("running").alias("status"))
    return report.list_sessions(s).select("label")


@query(_STORED + """, tl AS (SELECT ev.aid, s, any_value(thr) AS thr, list({'t': t, 'v': x} ORDER BY t) AS p FROM ev JOIN ep ON ev.aid = ep.aid AND ev.k = ep.k AND t <= e GROUP BY ev.aid, s),
q AS (SELECT aid, s, thr, unnest(p) AS u, list_min(list_transform(p, lambda z: z.t)) AS x0, list_max(list_transform(p, lambda z: z.t)) AS x1, greatest(list_max(list_transform(p, lambda z: z.v)), thr) * 1.15 AS top FROM tl)
SELECT aid AS anomaly_id, s AS start_t, CAST(trunc(36 + (u.t - x0) / (CASE WHEN x1 = x0 THEN 1 ELSE x1 - x0 END) * 448) AS INT) AS x, CAST(trunc(164 - u.v / top * 128) AS INT) AS y, CAST(trunc(164 - thr / top * 128) AS INT) AS threshold_y FROM q""")
def plot_points(spark, sf):
    p = report.plot_points(stored_events(spark, sf)).select("anomaly_id", F.col("start").alias("start_t"), "threshold_y", F.explode("points").alias("p"))
    return p.select("anomaly_id", "start_t", "p.x", "p.y", "threshold_y")


# --- beyond SQL -------------------------------------------------------------------------------------


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS w FROM events),
c AS (SELECT user_id, min(w) AS w, 0 AS idx FROM e GROUP BY user_id
  UNION ALL SELECT c.user_id, min(e.w) AS w, any_value(c.idx) + 1 AS idx FROM c JOIN e ON e.user_id = c.user_id AND e.w > c.w AND NOT (e.w - c.w < 1.0 / (CAST(2 AS DOUBLE) / 3600)) GROUP BY c.user_id)
SELECT user_id AS session_id, w AS "at", CAST(idx AS BIGINT) AS idx, idx / (CAST(2 AS DOUBLE) / 3600) AS t FROM c""")
def stream_rate_limit(spark, sf):
    """Each user's events, at most two an hour."""
    e = read(spark, sf, "events").select(F.col("user_id").alias("session_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return rate_limit(e, 2 / 3600)


@query(_FULL + _EVENT_COLUMNS)
def stream_events(spark, sf):
    """events_suppressed from a stream: the readings come in four files in order of time, then the mark of the session's end."""
    folder, r = work_path(spark, "stream"), work_path(spark, "readings")
    readings(spark, sf).write.parquet(r)
    r = spark.read.parquet(r)
    low, high = r.agg(F.min("t"), F.max("t")).first()
    for k in range(4):
        live.append_readings(r.where(F.floor((F.col("t") - low) / (high - low + 1) * 4) == k), f"{folder}/in")
    live.append_readings(live.end_marks(r), f"{folder}/in")
    return event_columns(live.run_available(f"{folder}/in", spark, EDGES, RULES, f"{folder}/out", f"{folder}/checkpoint"))


@query("""WITH RECURSIVE c AS (SELECT 0 AS n, CAST([] AS BIGINT[]) AS tl UNION ALL SELECT n + 1, CASE WHEN len(tl) < 50 THEN list_append(tl, n) ELSE list_append(list_slice(list_append(tl, n), 1, len(tl) + 1, 2), n) END FROM c WHERE n < 500)
SELECT unnest(range(len(tl))) AS pos, unnest(tl) AS v FROM c WHERE n = 500""")
def timeline_cap(spark, sf):
    tl = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(499)), lambda i: i.cast("long")).alias("tl"))
    return tl.select(F.posexplode(events.capped(F.col("tl"), 50)).alias("pos", "v")).select(F.col("pos").cast("long").alias("pos"), "v")


@query()
def image_operators(spark, sf):
    """Corners, tracking, components and reading on frames of the synthetic scene: one row a frame."""
    import numpy as np
    import pyarrow as pa

    from wachter.functions.image import components, dilate, good_corners, gray, pyramid, track
    from wachter.functions.ocr import read_text

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                g = gray(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], 3))
                p = good_corners(g, 40, 0.03, 7)
                q, ok = track(pyramid(g, 3), pyramid(np.roll(g, 2, 1), 3), p)
                out.append({"idx": r["idx"], "elements": components(dilate(g > 220, 15))[1], "corners": len(p), "tracked": int((ok & (abs(q[:, 0] - p[:, 0] - 2) < 0.5)).sum()), "text": read_text(g[12:30, 10:74])})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("idx", pa.int64()), ("elements", pa.int32()), ("corners", pa.int32()), ("tracked", pa.int32()), ("text", pa.string())]))

    return synthetic_frames(spark).mapInArrow(run, "idx long, elements int, corners int, tracked int, text string")


#: The overlays of the synthetic scene, by place.
_OVERLAYS = "VALUES ('cam01', 'CAM01'), ('temp22', 'TEMP22'), ('rec', 'REC'), ('stat01', 'STAT01')"


@query(f"SELECT element, text FROM ({_OVERLAYS}) AS e(element, text)")
def hud_elements(spark, sf):
    """The overlays that the calibration of the whole scene finds, by bright pixels that a dilation joins, and reads."""
    return hud.HudDetector().elements(scene(spark).where("t < 10")).select("element", "text")


@query(f"SELECT element, 200 AS frames, true AS near_home, true AS read FROM ({_OVERLAYS}) AS e(element, text)")
def hud_measures(spark, sf):
    """Each overlay in all frames of the calibration: where it is seen, it is at its place, and reads as itself nearly always."""
    h, f = hud.HudDetector(), scene(spark).where("t < 10")
    el = h.elements(f)
    d = h.deviations(h.measure(f, el), el).groupBy("element").agg(F.count("*").cast("int").alias("frames"), (F.max("position") < 2).alias("near_home"), (F.avg("text_dist") < 0.1).alias("read"))
    return d.select("element", "frames", "near_home", "read")


def scene(spark) -> DataFrame:
    return synthetic_frames(spark).select(F.lit("scene").alias("session_id"), "*")
