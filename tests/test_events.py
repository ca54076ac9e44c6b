import random

import pytest
from pyspark.sql import functions as F

from wachter.operators import events as E
from wachter.operators.suppression import edge_table, edges_of, expand
from wachter.sources.store import Store
from wachter.streaming.live import LiveSession, Signals, append_readings, by_target, end_marks, run_available

SCHEMA = "session_id string, t double, anomaly_id string, intensity double, threshold double, detector string"
RULES = {"a/*": ["b/*"], "c": ["*"], "b/1": ["a/1"], "b/*": ["d"]}
IDS = ["a/1", "a/2", "b/1", "b/2", "c", "d"]


def sessions(n, seed, drop):
    rng = random.Random(seed)
    for s in range(n):
        fps, level = rng.choice([10, 20, 30]), dict.fromkeys(IDS, 0.0)
        for i in range(rng.randint(0, 160)):
            for a in IDS:
                if rng.random() < 0.06:
                    level[a] = rng.choice([0.0, 0.0, 2.0, 5.0])
                if rng.random() >= drop[s % len(drop)]:
                    yield (f"s{s}", i / fps, a, level[a] + rng.random() / 2, 1.0 + (i % 3) * 0.1, a[0])


def machine(rows, rules, edges):
    out, by = [], {}
    for r in rows:
        by.setdefault(r[0], {}).setdefault(r[1], []).append((r[2], r[3], r[4], r[5]))
    for s, times in by.items():
        m = Signals(rules, by_target(edges))
        for t in sorted(times):
            out += [{"session_id": s, **e} for e in m.step(t, times[t])]
        out += [{"session_id": s, **e} for e in m.flush()]
    return out


def key(e):
    tl = tuple((p["t"], p["v"]) for p in e["timeline"])
    return (e["session_id"], e["anomaly_id"], e["start"], e["end"], e["max_intensity"], e["threshold"], e["detector"], e["closed_at"], tl)


@pytest.mark.parametrize("rules", [E.Rules(), E.Rules(0.5, 0.0, 0.0), E.Rules(0.0, 0.1, 1.0), E.Rules(1.0, 0.5, 2.5, 7)])
def test_windows_equal_the_state_machine(spark, rules):
    rows = list(sessions(24, 11, [0.0, 0.3, 0.7]))
    edges = expand(RULES, IDS)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {key(r.asDict(recursive=True)) for r in E.detect_events(df, spark.createDataFrame(sorted(edges), "sup string, tgt string"), rules).collect()}
    want = {key(e) for e in machine(rows, rules, edges)}
    assert want and got == want


def test_stream_equals_batch(spark, tmp_path):
    rows, edges, rules = list(sessions(6, 5, [0.2])), expand(RULES, IDS), E.Rules()
    df = spark.createDataFrame(rows, SCHEMA)
    for k in range(4):  # four files in order of time, and an end mark for each session
        part = df.where(f"t >= {k} * 1.5" + (f" and t < {k + 1} * 1.5" if k < 3 else ""))
        append_readings(part.unionByName(end_marks(df)) if k == 3 else part, str(tmp_path / "in"))
    out = run_available(str(tmp_path / "in"), spark, edges, rules, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert {key(r.asDict(recursive=True)) for r in out.collect()} == {key(e) for e in machine(rows, rules, edges)}


def test_live_session(spark, tmp_path):
    """Events are in the store while the session runs, keep their numbers, survive a restart, and are whole after the stop."""
    rows, edges, rules = [r for r in sessions(12, 5, [0.0]) if r[0] == "s8"], [], E.Rules(0.1, 0.05, 0.0)
    df, store, folder = spark.createDataFrame(rows, SCHEMA), Store(spark, str(tmp_path / "db")), str(tmp_path / "in")
    half = max(r[1] for r in rows) / 2
    store.create_session("s8", "n", "live", 20.0, 1.0)
    append_readings(df.where(f"t < {half}"), folder)
    live = LiveSession(store, "s8", folder, edges, rules).start()
    live.query.processAllAvailable()
    before = {r["id"]: r["start"] for r in store.list_events("s8").collect()}
    live.query.stop()
    append_readings(df.where(f"t >= {half}"), folder)
    live = LiveSession(store, "s8", folder, edges, rules).start()
    live.stop(9.0)
    want = sorted((e["anomaly_id"], e["start"], e["end"], e["max_intensity"]) for e in machine(rows, rules, edges))
    after = store.list_events("s8").collect()
    assert before and len(before) < len(after) and all(next(r["start"] for r in after if r["id"] == i) == t for i, t in before.items())
    assert sorted((r["anomaly_id"], r["start"], r["end"], r["max_intensity"]) for r in after) == want and [r["id"] for r in sorted(after, key=lambda r: r["id"])] == list(range(1, len(after) + 1))
    assert store.get_session("s8").first()["status"] == "completed" and {r["id"]: r["n_events"] for r in store.overview().collect()} == {"s8": len(after)}
    with pytest.raises(RuntimeError):
        live.stop()
    again = store.list_events("s8").drop("id").withColumn("closed_at", F.lit(None).cast("double"))
    store.append_events(again.limit(1), 77)
    store.append_events(again.limit(1), 77)  # a batch that is run again
    assert store._live().where("session_id = 's8'").count() == len(after) + 1 and store.list_events("s8").count() == len(after)


@pytest.mark.parametrize("most", [1, 2, 3, 7, 50])
def test_kept_points(most):
    held = []
    for n in range(400):
        assert E.kept_points(n, most).tolist() == held
        held = [*held, n]
        if len(held) > most:
            held = [*held[::2], held[-1]]


def run(spark, pattern, n=100, ids=("x",), step=0.1, rules=E.Rules(0.5, 0.4, 2.5), edges=(), **kw):
    rows = [("s", i * step, a, 5.0 if pattern(i * step) else 0.0, 1.0, "d") for i in range(n) for a in ids]
    e = spark.createDataFrame(list(edges), "sup string, tgt string") if edges else None
    return E.detect_events(spark.createDataFrame(rows, SCHEMA), e, rules).orderBy("start").collect()


def test_cases(spark):
    (one,) = run(spark, lambda t: 2.0 <= t <= 5.0)
    assert (one["start"], one["end"], one["max_intensity"], one["timeline"][0]["t"]) == (pytest.approx(2), pytest.approx(5), 5, pytest.approx(2))
    assert run(spark, lambda t: 2.0 <= t < 2.2, 50) == []
    (gap,) = run(spark, lambda t: 2 <= t <= 3 or 3.3 <= t <= 4.5)
    assert gap["end"] == pytest.approx(4.5)
    (flush,) = run(spark, lambda t: t >= 1, 30)
    assert flush["end"] == pytest.approx(2.9) and flush["closed_at"] is None
    only = run(spark, lambda t: True, 30, ("primary", "secondary"), edges=[("primary", "secondary")])
    assert [r["anomaly_id"] for r in only] == ["primary"]
    (cap,) = run(spark, lambda t: True, 2000, step=0.01, rules=E.Rules(0.5, 0.4, 2.5, 50))
    assert len(cap["timeline"]) <= 101
    both = run(spark, lambda t: True, 30, ("p", "q"), edges=[("p", "q"), ("q", "p")])
    assert both == []  # each suppresses the other


def test_numbers_and_enrichment(spark):
    rows = [("s", i / 10, a, 5.0 if lo <= i < hi else 0.0, 1.0, "d") for i in range(100) for a, lo, hi in (("x", 10, 60), ("y", 20, 30), ("z", 50, 100))]
    ev = E.number(E.detect_events(spark.createDataFrame(rows, SCHEMA), None, E.Rules()))
    assert [(r["id"], r["anomaly_id"]) for r in ev.orderBy("id").collect()] == [(1, "y"), (2, "x"), (3, "z")]
    snap = spark.createDataFrame([("s", "x", 1.0, '{"a":1}', [(1, 2, 3, 4)])], "session_id string, anomaly_id string, t double, metadata string, regions array<struct<x:int,y:int,w:int,h:int>>")
    got = {r["anomaly_id"]: (r["metadata"], len(r["regions"])) for r in E.enrich(ev, snap).collect()}
    assert got == {"x": ('{"a":1}', 1), "y": ("{}", 0), "z": ("{}", 0)}
    assert E.series(ev).where("anomaly_id = 'y'").count() == 10


def test_missing_threshold_is_an_error(spark):
    i = spark.createDataFrame([("s", 0.0, "x", 1.0, "d")], "session_id string, t double, anomaly_id string, intensity double, detector string")
    t = spark.createDataFrame([("s", "y", 1.0)], "session_id string, anomaly_id string, threshold double")
    with pytest.raises(Exception, match="no calibrated threshold for x"):
        E.with_thresholds(i, t).collect()


def test_patterns(spark):
    assert expand({"*": ["*"]}, ["a", "b"]) == set()  # captures carry over: each would suppress itself alone
    assert expand({"c": ["*"]}, ["a", "c"]) == {("c", "a")}
    assert expand({"hud/*": ["spatial/*"]}, ["hud/a", "spatial/a", "spatial/b"]) == {("hud/a", "spatial/a")}
    assert expand({"hud/*/size": ["hud/*/text"]}, ["hud/a/size", "hud/a/text", "hud/b/text"]) == {("hud/a/size", "hud/a/text")}
    assert expand({"hud/*": ["t.x"]}, ["hud/a", "tox"]) == set()
    rules = {"hud/*/size": ["hud/*/text", "hud/*/position"], "f": ["*"], "hud/*": ["sp/*"], "a.b": ["hud/a/*"], "*x*": ["*y*"]}
    ids = ["hud/a/size", "hud/a/text", "hud/b/text", "f", "sp/a/size", "sp/q", "a.b", "aab", "1x2", "1y2", "1y3"]
    r = spark.createDataFrame([(a, b) for a, bs in rules.items() for b in bs], "left string, right string")
    got = edges_of(spark.createDataFrame([(i,) for i in ids], "anomaly_id string"), r)
    assert {tuple(x) for x in got.collect()} == expand(rules, ids) == {tuple(x) for x in edge_table(spark, rules, ids).collect()}
