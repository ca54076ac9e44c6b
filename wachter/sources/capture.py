"""Live capture: options, probing, pacing. A device is anything with read() -> (ok, image), so that it can be a card, a network stream or a
test's list; the capture library itself is the caller's."""

from __future__ import annotations

import glob
import importlib
import itertools
import time
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from wachter.functions.image import resize_area
from wachter.schemas import FRAMES
from wachter.sources import FrameSource, SourceError
from wachter.work import work_path

#: A frame table's columns.
_FRAME = FRAMES.removeprefix("session_id string, ")
MAX_PROBE, BURST = 10, 20


def parse_device(device: Any) -> int | str:
    """A number, or a text of digits, is an index; another text is a path."""
    if isinstance(device, str):
        return int(device.strip()) if device.strip().isdigit() else device.strip()
    if isinstance(device, int) and not isinstance(device, bool):
        return device
    raise SourceError(f"a device is an index or a path, not {device!r}")


def list_capture_devices(opens: Callable[[int | str], bool], max_probe: int = MAX_PROBE, paths: list[str] | None = None) -> list[str]:
    """Those of /dev/video* (sorted), then of the first indices, that open."""
    tried = [*sorted(glob.glob("/dev/video*") if paths is None else paths), *range(max_probe)]
    return list(dict.fromkeys(str(d) for d in tried if opens(d)))


def stream_size(reported: tuple[int, int], first: tuple[bool, np.ndarray | None]) -> tuple[int, int]:
    """(width, height) of a first frame, or else as reported."""
    ok, image = first
    w, h = image.shape[1::-1] if ok and image is not None else map(int, reported)
    if w <= 0 or h <= 0:
        raise SourceError("the device reports no resolution and gives no frame")
    return int(w), int(h)


def estimate_fps(read: Callable[[], tuple[bool, Any]], clock: Callable[[], float] = time.monotonic, burst: int = BURST) -> float:
    """Frames by seconds over a short burst; 0 with fewer than two frames."""
    begin, n = clock(), 0
    while n < burst and read()[0]:
        n += 1
    took = clock() - begin
    return n / took if n > 1 and took > 0 else 0.0


def processing_size(native: tuple[int, int], config: dict) -> tuple[int, int] | None:
    """(width, height) to scale to: as given, or in proportion if one is given; None if neither is."""
    want = (config.get("processing_width"), config.get("processing_height"))
    if want == (None, None):
        return None
    w, h = (None if x is None else int(x) for x in want)
    if w is None:
        return max(1, int(round(native[0] * (h / native[1])))), h
    return w, h if h is not None else max(1, int(round(native[1] * (w / native[0]))))


def emitted(times: np.ndarray, fps: float, last: float | None = None) -> np.ndarray:
    """Which of the times are passed on: the first, and each that is not less than 1 / fps after the last that was (last: before these)."""
    keep, gap = np.zeros(len(times), bool), 1.0 / fps if fps > 0 else 0.0
    for i, t in enumerate(times.tolist()):
        if last is None or not t - last < gap:
            keep[i], last = True, t
    return keep


def rate_limit(arrivals: DataFrame, fps: float, key: str = "session_id", time_col: str = "at") -> DataFrame:
    """The arrivals that a limited stream passes on, with all their columns, idx (their number) and t = idx / fps. Each one passed on is what the
    next is measured against, so a session is walked in order: partitions are sorted by session and time and read batch by batch, and all
    that is kept between batches is the session's last time and number."""
    names = [c for c in arrivals.columns if c not in ("idx", "t")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last, n = None, None, 0
        for b in batches:
            if not b.num_rows:
                continue
            keys, times = b.column(key), b.column(time_col).to_numpy(zero_copy_only=False)
            ends = np.flatnonzero(np.append([x != y for x, y in zip(keys.to_pylist(), keys.to_pylist()[1:], strict=False)], True)) + 1
            keep, idx = np.zeros(len(times), bool), np.zeros(len(times), np.int64)
            for i, j in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                k = keys[int(i)].as_py()
                if now is None or now[0] != k:
                    now, last, n = (k,), None, 0
                keep[i:j] = emitted(times[i:j], fps, last)
                mine = np.flatnonzero(keep[i:j]) + i
                idx[mine] = n + np.arange(len(mine))
                if len(mine):
                    last, n = float(times[mine[-1]]), n + len(mine)
            out = b.append_column("idx", pa.array(idx)).filter(pa.array(keep))
            yield out.select([*names, "idx"])

    src = arrivals.select(*names).where(F.col(time_col).isNotNull()).repartition(key).sortWithinPartitions(key, time_col)
    passed = src.mapInArrow(run, src.withColumn("idx", F.lit(0).cast("long")).schema)
    return passed.withColumn("t", F.col("idx") / F.lit(float(fps)))


class CaptureSource(FrameSource):
    """Options: device (required), capture_fourcc (four characters), capture_buffer_size, processing_width, processing_height, processing_fps.
    connect(device, options) opens it and returns an object with read(), size, fps and release()."""

    def __init__(self, config: dict | None = None, connect: Callable[[int | str, dict], Any] | None = None, clock: Callable[[], float] = time.monotonic, others: Callable[[], list[str]] = list):
        super().__init__(config)
        c = self.config
        if "device" not in c:
            raise SourceError("a capture source needs a device")
        if (code := c.get("capture_fourcc")) and len(code) != 4:
            raise SourceError(f"capture_fourcc has four characters, not {code!r}")
        self.device, self.clock = parse_device(c["device"]), clock
        try:
            self.stream = connect(self.device, {"buffer_size": c.get("capture_buffer_size", 1), "fourcc": code}) if connect else None
        except OSError:
            self.stream = None
        if self.stream is None:
            raise SourceError(f"can't open {self.device!r}; devices that open: {', '.join(others()) or 'none'}")
        self.native_size = stream_size(self.stream.size, self.stream.read())
        self.native_fps = float(self.stream.fps) if self.stream.fps > 0 else estimate_fps(self.stream.read, clock)
        if self.native_fps <= 0:
            raise SourceError("the device's frame rate isn't known; set processing_fps or check the signal")
        self.output_size = processing_size(self.native_size, c)
        self._fps = float(c["processing_fps"]) if c.get("processing_fps") is not None else self.native_fps
        if self._fps <= 0:
            raise SourceError("processing_fps has to be over 0")

    @property
    def fps(self) -> float:
        return self._fps

    def read(self) -> Iterator[tuple[int, float, np.ndarray]]:
        """(idx, t, image) of the frames passed on; t counts them, it isn't the clock."""
        last, idx = None, 0
        while True:
            ok, image = self.stream.read()
            if not ok:
                return
            now = self.clock()
            if last is not None and now - last < 1.0 / self._fps:
                continue
            last = now
            if self.output_size:
                image = np.rint(resize_area(image, *self.output_size)).astype(np.uint8)
            yield idx, idx / self._fps, image
            idx += 1

    def frames(self, spark: SparkSession, most: int | None = None) -> DataFrame:
        """A finite recording: the stream goes to a work table file by file, so the driver holds one file's frames. most: ends it after so many;
        an endless stream needs it, or is read with format("wachter_capture")."""
        path = work_path(spark, "capture")
        n = self.record(spark, path, most=most)
        return spark.read.schema(_FRAME).parquet(path) if n else spark.createDataFrame([], _FRAME)

    def record(self, spark: SparkSession, path: str, frames_per_file: int = 200, most: int | None = None) -> int:
        """Appends the stream to a frame table, file by file; returns the number of frames."""
        n, stream = 0, self.rows()
        while held := list(itertools.islice(stream, frames_per_file if most is None else min(frames_per_file, most - n))):
            spark.createDataFrame(held, _FRAME).coalesce(1).write.mode("append").parquet(path)
            n += len(held)
        return n

    def rows(self) -> Iterator[tuple]:
        """The stream as rows of a frame table."""
        for i, t, m in self.read():
            yield i, t, m.shape[0], m.shape[1], m.shape[2] if m.ndim == 3 else 1, m.tobytes()

    def close(self) -> None:
        self.stream.release()


class CaptureDataSource(DataSource):
    """spark.readStream.format("wachter_capture") with a capture source's options, and connect: "module:function" that opens the device, and
    frames_per_batch: the most that one batch takes. A live device has one reader, so frames come over the driver, a bounded batch at a time;
    the batches that aren't committed yet are kept to be read again."""

    @classmethod
    def name(cls) -> str:
        return "wachter_capture"

    def schema(self) -> str:
        return _FRAME

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return CaptureStreamReader(dict(self.options))


class CaptureStreamReader(SimpleDataSourceStreamReader):
    """The device is opened by the first read, on the driver. What is sent to a task that reads a batch again is the options and the frames of
    the batches that aren't committed."""

    def __init__(self, options: dict):
        self.where, _, self.what = options.get("connect", "").partition(":")
        if not self.what:
            raise SourceError("a capture stream needs connect=module:function")
        self.config = {k: options[k] for k in ("device", "capture_fourcc") if k in options}
        self.config |= {k: float(options[k]) for k in ("processing_fps",) if k in options} | {k: int(options[k]) for k in ("processing_width", "processing_height") if k in options}
        self.most, self.stream, self.held = int(options.get("frames_per_batch", 100)), None, []

    def __getstate__(self) -> dict:
        return self.__dict__ | {"stream": None}

    def initialOffset(self) -> dict:
        return {"frames": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        if self.stream is None:
            self.stream = CaptureSource(self.config, getattr(importlib.import_module(self.where), self.what)).rows()
        new = list(itertools.islice(self.stream, self.most))
        self.held += [(start["frames"] + i, r) for i, r in enumerate(new)]
        return iter(new), {"frames": start["frames"] + len(new)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter([r for i, r in self.held if start["frames"] <= i < end["frames"]])

    def commit(self, end: dict) -> None:
        self.held = [(i, r) for i, r in self.held if i >= end["frames"]]


class SyntheticDataSource(DataSource):
    """spark.read.format("wachter_scene").option("frames", n).option("fps", 20): the synthetic scene as a data source, a partition for each
    chunk of frames."""

    @classmethod
    def name(cls) -> str:
        return "wachter_scene"

    def schema(self) -> str:
        return _FRAME

    def reader(self, schema) -> DataSourceReader:
        return _SceneReader(self.options)


class _SceneReader(DataSourceReader):
    def __init__(self, options: dict):
        self.n, self.fps, self.seed, self.chunk = int(options.get("frames", 1720)), float(options.get("fps", 20)), int(options.get("seed", 7)), int(options.get("chunk", 100))
        if self.n < 0 or self.fps <= 0:
            raise SourceError("frames can't be negative, and fps has to be over 0")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(0, self.n, self.chunk)] or [InputPartition(0)]

    def read(self, partition: InputPartition):
        from wachter.sources.synthetic import Scene

        scene = Scene(self.seed)
        for i in range(partition.value, min(self.n, partition.value + self.chunk)):
            m = scene.frame(i / self.fps, i)
            yield i, i / self.fps, m.shape[0], m.shape[1], m.shape[2], m.tobytes()
