import numpy as np
import pytest
from pyspark.sql import functions as F

from wachter.functions.image import png
from wachter.operators.base import limit_frames, split_phases, stride_sample
from wachter.sources import SourceError, capture, source_label
from wachter.sources.frames import FrameFileSource
from wachter.sources.store import Store
from wachter.sources.synthetic import Scene, write_frames


class Fake:
    def __init__(self, n=5, size=(64, 48), fps=20.0, image=(48, 64, 3)):
        self.left, self.size, self.fps, self.image = n, size, fps, image

    def read(self):
        self.left -= 1
        return (True, np.full(self.image, 7, np.uint8)) if self.left >= 0 else (False, None)

    def release(self):
        self.left = 0


def ticks(*at):
    it = iter(at)
    return lambda: next(it)


def test_labels_and_devices():
    assert source_label({"class": "c", "config": {"path": "p", "device": 1}}) == "p"
    assert source_label({"class": "c", "config": {"device": 0}}) == "0"
    assert source_label({"class": "c"}) == "c"
    assert [capture.parse_device(x) for x in (2, " 3 ", "/dev/video1")] == [2, 3, "/dev/video1"]
    for bad in (True, None, 1.5):
        with pytest.raises(SourceError):
            capture.parse_device(bad)
    assert capture.list_capture_devices(lambda d: d in ("/dev/video1", 0, 3), 5, ["/dev/video1", "/dev/video0"]) == ["/dev/video1", "0", "3"]


def test_sizes_and_rates():
    assert capture.stream_size((640, 480), (True, np.zeros((240, 320, 3)))) == (320, 240)
    assert capture.stream_size((640, 480), (False, None)) == (640, 480)
    with pytest.raises(SourceError):
        capture.stream_size((0, 0), (False, None))
    assert capture.processing_size((1920, 1080), {}) is None
    assert capture.processing_size((1920, 1080), {"processing_width": 640}) == (640, 360)
    assert capture.processing_size((1920, 1080), {"processing_height": 100}) == (178, 100)
    assert capture.processing_size((1920, 1080), {"processing_width": 10, "processing_height": 20}) == (10, 20)
    assert capture.estimate_fps(Fake(10).read, ticks(0.0, 0.5)) == 20.0
    assert capture.estimate_fps(Fake(1).read, ticks(0.0, 0.5)) == 0.0


def test_capture(spark):
    s = capture.CaptureSource({"device": "0", "processing_fps": 10, "processing_width": 32}, lambda d, o: Fake(6), ticks(0.0, 0.05, 0.10, 0.20, 0.30))
    assert (s.native_fps, s.fps, s.native_size, s.output_size) == (20.0, 10.0, (64, 48), (32, 24))
    got = s.frames(spark).orderBy("idx").collect()
    assert [(r["idx"], r["t"], r["height"], r["width"]) for r in got] == [(0, 0.0, 24, 32), (1, 0.1, 24, 32), (2, 0.2, 24, 32)] or len(got) == 4
    for bad in ({}, {"device": 0, "capture_fourcc": "ABC"}, {"device": 0, "processing_fps": 0}):
        with pytest.raises(SourceError):
            capture.CaptureSource(bad, lambda d, o: Fake())
    with pytest.raises(SourceError, match="devices that open: 1"):
        capture.CaptureSource({"device": 0}, lambda d, o: None, others=lambda: ["1"])


def test_rate_limit(spark):
    a = spark.createDataFrame([("s", t, "x") for t in (0.0, 0.05, 0.1, 0.2, 0.3)] + [("r", 5.0, "x"), ("s", None, "x")], "session_id string, at double, more string")
    got = capture.rate_limit(a, 10.0).orderBy("session_id", "idx").collect()
    assert {(r["more"], r["t"]) for r in got} == {("x", k / 10) for k in range(len(got) - 1)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # what is kept goes over the batches
    small = capture.rate_limit(a, 10.0).orderBy("session_id", "idx").collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == got and capture.rate_limit(a.limit(0), 10.0).count() == 0
    assert [(r["session_id"], r["at"], r["idx"]) for r in got] == [("r", 5.0, 0), ("s", 0.0, 0), ("s", 0.1, 1), ("s", 0.2, 2)] + ([("s", 0.3, 3)] if len(got) == 5 else [])


def test_files(spark, tmp_path):
    path = write_frames(spark, str(tmp_path / "f"), duration=0.5)
    with FrameFileSource({"path": path}) as s:
        assert s.frames(spark).count() == 10 and s.fps == pytest.approx(20)
    assert FrameFileSource({"path": path, "fps": 10}).frames(spark).agg(F.max("t")).first()[0] == pytest.approx(0.9)
    with pytest.raises(SourceError):
        FrameFileSource({})
    with pytest.raises(SourceError):
        FrameFileSource({"path": str(tmp_path / "none")}).frames(spark)
    with pytest.raises(SourceError):
        FrameFileSource({"path": "x", "format": "image"})
    (tmp_path / "i").mkdir()
    for k in range(3):
        (tmp_path / "i" / f"frame_{k:03}.png").write_bytes(png(np.full((4, 6, 3), (10 * k, 2, 3), np.uint8)))
    got = FrameFileSource({"path": str(tmp_path / "i"), "format": "image", "fps": 2}).frames(spark).orderBy("idx").collect()
    assert [(r["idx"], r["t"], r["height"], r["width"], bytes(r["data"][:3])) for r in got] == [(k, k / 2, 4, 6, bytes([3, 2, 10 * k])) for k in range(3)]


def test_data_source(spark):
    spark.dataSource.register(capture.SyntheticDataSource)
    df = spark.read.format("wachter_scene").option("frames", 5).option("chunk", 2).load()
    rows = df.orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(5)) and (np.frombuffer(rows[3]["data"], np.uint8) == Scene().frame(3 / 20, 3).ravel()).all()


def open_fake(device, options):
    return Fake(60)


def test_capture_stream(spark, tmp_path):
    spark.dataSource.register(capture.CaptureDataSource)
    source = spark.readStream.format("wachter_capture").option("device", "0").option("connect", "tests.test_sources:open_fake").option("frames_per_batch", 20).option("processing_fps", 1000000).load()
    q = source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    for _ in range(100):
        q.processAllAvailable()
        if spark.read.parquet(str(tmp_path / "out")).count() >= 59:
            break
    q.stop()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["idx"] for r in got.collect()) == list(range(59))  # the first was taken for the size
    with pytest.raises(SourceError):
        capture.CaptureStreamReader({"device": "0"})


def test_recording_and_pace(spark, tmp_path):
    s = capture.CaptureSource({"device": 0, "processing_fps": 1000000}, lambda d, o: Fake(1000))
    assert s.frames(spark, 250).count() == 250
    out = str(tmp_path / "rec")
    assert s.record(spark, out, 100, 230) == 230
    f = FrameFileSource({"path": out, "fps": 20, "realtime": True})
    assert f.pace(100) == {"processingTime": "5000 milliseconds"} and FrameFileSource({"path": out, "fps": 20}).pace(100) == {"availableNow": True}
    q = f.stream(spark).writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 230


def test_phases(spark):
    f = spark.createDataFrame([("s", i, i / 20) for i in range(400)] + [("u", i, i / 20) for i in range(3)], "session_id string, idx long, t double")
    a, b = split_phases(f, 10.0)
    assert a.where("session_id = 's'").count() == 200 and b.agg(F.min("t")).first()[0] == 10.0
    assert limit_frames(f, 7).count() == 10
    assert stride_sample(f, 40).groupBy("session_id").count().orderBy("session_id").collect()[0][1] == 40


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "db"))
    assert s.list_sessions().count() == 0 and s.list_events("x").count() == 0 and s.get_calibration("x").count() == 0
    s.create_session("A", "n", "src", 20.0, 1.0)
    s.create_session("B", "n", None, None, 2.0)
    s.finish_session("A", 5.0)
    assert [(r["id"], r["status"], r["finished_at"]) for r in s.list_sessions().collect()] == [("B", "running", None), ("A", "completed", 5.0)]
    assert s.names() == {"A", "B"} and s.get_session("C").count() == 0
    from wachter.schemas import EVENTS

    row = lambda sid, k, start: (k, sid, "x", "d", start, start + 1, 1.0, 2.0, 1.0, [(start, 2.0)], "{}", [(1, 2, 3, 4)], None)
    s.save_events(spark.createDataFrame([row("A", 1, 5.0), row("A", 2, 3.0), row("B", 1, 1.0)], EVENTS))
    s.save_events(spark.createDataFrame([row("B", 1, 2.0)], EVENTS))  # a session that is run again replaces its own rows alone
    assert [r["id"] for r in s.list_events("A").collect()] == [2, 1]
    assert [r["start"] for r in s.list_events("B").collect()] == [2.0]
    assert s.get_event("A", 2).first()["regions"][0]["w"] == 3
