"""The synthetic scene from frames to reports, on a shortened schedule."""

import re

import pytest

from wachter.__main__ import main
from wachter.config import merge_defaults
from wachter.operators.hud import HudDetector
from wachter.plans.export import export_session
from wachter.plans.monitor import monitor
from wachter.plans.watch import Watch
from wachter.sources import SourceError
from wachter.sources.store import Store
from wachter.sources.synthetic import synthetic_frames

SCHEDULE = [("noise", 6.0, 7.5, "temporal/noise"), ("flicker", 11.0, 12.5, "temporal/flicker"), ("hud_text", 17.0, 18.5, "hud/*/text"), ("spatial", 21.0, 22.5, "spatial/distortion")]


@pytest.fixture(scope="module")
def session(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("session")
    synthetic_frames(spark, 240, 10.0, schedule=SCHEDULE).write.parquet(str(d / "frames"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    c = merge_defaults({"data_dir": str(d / "data"), "video_source": {"config": {"path": str(d / "frames")}}, "calibration": {"duration_seconds": 5.0}})
    c["detectors"][2]["config"] = {"max_corners": 40}
    return c, monitor(spark, c)


def test_events_follow_the_schedule(spark, session):
    c, sid = session
    s = Store(spark, c["data_dir"])
    ev = s.list_events(sid).collect()
    assert len(ev) == len(SCHEDULE)
    for e, (_, a, b, pattern) in zip(ev, SCHEDULE, strict=True):
        assert re.fullmatch(pattern.replace("*", ".+"), e["anomaly_id"])
        assert abs(e["start"] - a) <= 2.6 and abs(e["end"] - b) <= 3.6
        assert e["max_intensity"] == max(p["v"] for p in e["timeline"]) and e["duration"] == e["end"] - e["start"] and e["media"]
    assert ev[3]["regions"] and '"tracked_points":40' in ev[3]["metadata"] and '"moved_points":' in ev[3]["metadata"]
    assert ev[2]["metadata"].startswith('{"element":"cam01"') and s.get_session(sid).first()["status"] == "completed"
    cal = s.get_calibration(sid).first()
    assert set(cal["thresholds"]) == {"temporal", "hud", "spatial"} and cal["annotations"].count('"id"') == 4


def test_exports(spark, session, tmp_path, capsys):
    c, sid = session
    rows = spark.read.option("header", True).csv(export_session(spark, c, sid, "csv", str(tmp_path / "o.csv")))
    assert rows.count() == len(SCHEDULE) and rows.columns[0] == "event_id"
    page = open(export_session(spark, c, sid, "html", str(tmp_path / "o.html"))).read()
    assert "<script" not in page and page.count("<section>") == len(SCHEDULE) and "data:image/gif;base64," in page and "cam01" in page
    assert "http" not in page
    with pytest.raises(ValueError):
        export_session(spark, c, sid, "pdf")
    with pytest.raises(ValueError):
        export_session(spark, c, "nobody")


def test_cli(spark, session, tmp_path, capsys):
    c, sid = session
    p = tmp_path / "c.yaml"
    p.write_text(f"data_dir: {c['data_dir']}\nvideo_source: {{config: {{path: {tmp_path}/none}}}}\n")
    assert main(["monitor", str(p)], spark) == 1 and "none" in capsys.readouterr().err
    assert main(["export", str(p), "--session", sid, "--format", "csv", "--out", str(tmp_path / "x")], spark) == 0
    assert main(["sessions", str(p)], spark) == 0 and sid in capsys.readouterr().out


def test_watch(spark, session, tmp_path):
    """Frames that come while the session runs give the events of the whole table."""
    c, sid = session
    store, every, folder = Store(spark, c["data_dir"]), spark.read.parquet(c["video_source"]["config"]["path"]), str(tmp_path / "growing")
    more = lambda a, b: every.where(f"t >= {a} and t < {b}").coalesce(1).write.mode("append").parquet(folder)
    live = merge_defaults({**c, "video_source": {"config": {"path": folder}}})
    more(0, 3)
    with pytest.raises(SourceError):
        Watch(spark, live).start()
    more(3, 6)
    w = Watch(spark, live).start()
    more(6, 13)
    w.query.processAllAvailable()
    w.live.query.processAllAvailable()
    early = store.list_events(w.session_id).collect()
    more(13, 24)
    assert w.stop() in store.names()
    key = lambda r: (r["anomaly_id"], r["start"], r["end"], round(r["max_intensity"], 9), round(r["threshold"], 9))
    got, want = store.list_events(w.session_id).collect(), store.list_events(sid).collect()
    assert [key(r) for r in got] == [key(r) for r in want] and {key(r) for r in early} <= {key(r) for r in got} and early
    assert store.get_session(w.session_id).first()["status"] == "completed" and store.get_calibration(w.session_id).count() == 1
    with pytest.raises(RuntimeError):
        w.stop()


def test_too_short_for_calibration(spark):
    f = synthetic_frames(spark, 10, 10.0).selectExpr("'s' as session_id", "*")
    el = HudDetector().elements(f)
    assert {r["element"] for r in el.collect()} == {"cam01", "rec", "temp22", "stat01"}
