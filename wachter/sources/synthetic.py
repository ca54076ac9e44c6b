"""A synthetic scene with scheduled anomalies. Any frame can be drawn on its own: all randomness is keyed by the frame's number."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wachter.functions.image import resize_area, rotation, warp
from wachter.functions.ocr import draw_text
from wachter.sources import FrameSource

#: The scene's size and times, and the anomalies with what they are expected to report.
WIDTH, HEIGHT, FPS, DURATION = 320, 240, 20.0, 86.0
NOISE_SIGMA, FLICKER_AMPLITUDE, FLICKER_HZ = 4.0, 7.0, 0.8
SCHEDULE = [
    ("noise", 16.0, 19.0, "temporal/noise"), ("flicker", 23.0, 26.0, "temporal/flicker"), ("contrast", 30.0, 33.0, "temporal/contrast"), ("hud_text", 37.0, 40.0, "hud/*/text"),
    ("hud_blink_freq", 44.0, 47.0, "hud/*/blink"), ("hud_blink_stop", 51.0, 54.0, "hud/*/blink"), ("hud_position", 58.0, 61.0, "hud/*/position"), ("hud_size", 65.0, 68.0, "hud/*/size"),
    ("spatial", 72.0, 75.0, "spatial/distortion"), ("overlap_flicker_noise", 79.0, 82.0, "temporal/flicker"),
]
#: Name, text, x, y, scale, blinking in Hz.
HUD = [("cam", "CAM01", 14, 28, 1.0, 0.0), ("rec", "REC", 250, 28, 1.0, 2.0), ("temp", "TEMP22", 118, 28, 0.9, 1.0), ("stat", "STAT01", 14, 220, 0.85, 0.0)]
#: Strengths.
STRONG_NOISE, STRONG_FLICKER, STRONG_FLICKER_HZ, LOW_CONTRAST, SHIFT, GROWTH, FAST_BLINK_HZ, TURN, ZOOM = 22.0, 38.0, 5.0, 0.45, (14, 10), 1.35, 6.0, 5.0, 1.12
#: Fixed value: the turn's centre.
CENTRE = (200.0, 110.0)


@lru_cache(4)
def background(seed: int, width: int = WIDTH, height: int = HEIGHT) -> np.ndarray:
    """Blocks and smooth hills, dark enough for overlays: many corners, none of them bright."""
    rng = np.random.default_rng([seed, 1])
    hills = resize_area(rng.uniform(60, 150, (6, 8)), width, height)
    img = hills + np.kron(rng.uniform(-28, 28, (-(-height // 12), -(-width // 12))), np.ones((12, 12)))[:height, :width]
    return np.clip(img, 20, 190)


def square(t: float, hz: float) -> bool:
    return int(t * hz * 2) % 2 == 0


class Scene:
    def __init__(self, seed: int = 7, schedule: Sequence[tuple] = SCHEDULE):
        self.seed, self.schedule = seed, schedule

    def active(self, t: float) -> set[str]:
        return {key for key, a, b, *_ in self.schedule if a <= t < b}

    def overlay(self, img: np.ndarray, t: float, on: set[str]) -> None:
        for name, text, x, y, scale, hz in HUD:
            if name == "cam":
                text = "ERR42" if "hud_text" in on else text
                x, y = (x + SHIFT[0], y + SHIFT[1]) if "hud_position" in on else (x, y)
                scale *= GROWTH if "hud_size" in on else 1.0
            if name == "rec":
                hz = 0.0 if "hud_blink_stop" in on else FAST_BLINK_HZ if "hud_blink_freq" in on else hz
            if not hz or square(t, hz):
                draw_text(img, text, x, y, scale, (255, 255, 255))

    def frame(self, t: float, index: int | None = None) -> np.ndarray:
        """The BGR frame at a time."""
        on, i = self.active(t), round(t * FPS) if index is None else index
        img = background(self.seed)
        if "spatial" in on:
            img = warp(img, rotation(*CENTRE, TURN, ZOOM))
        img = np.repeat(img[..., None], 3, 2)
        self.overlay(img, t, on)
        if "contrast" in on:
            img = img.mean() + LOW_CONTRAST * (img - img.mean())
        img = img + FLICKER_AMPLITUDE * np.sin(2 * np.pi * FLICKER_HZ * t)
        if on & {"flicker", "overlap_flicker_noise"}:
            img = img + (STRONG_FLICKER if square(t, STRONG_FLICKER_HZ) else -STRONG_FLICKER)
        img = np.clip(img, 0, 255)
        sigma = np.hypot(NOISE_SIGMA, STRONG_NOISE) if on & {"noise", "overlap_flicker_noise"} else NOISE_SIGMA
        noise = np.random.default_rng([self.seed, 2, i]).normal(0, sigma, img.shape)
        return np.clip(img + noise, 0, 255).astype(np.uint8)


def synthetic_frames(spark: SparkSession, n: int | None = None, fps: float = FPS, seed: int = 7, schedule: Sequence[tuple] = SCHEDULE, partitions: int | None = None) -> DataFrame:
    """(idx, t, height, width, channels, data), drawn in parallel."""
    scene = Scene(seed, tuple(schedule))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 50):
                rows = [(i, scene.frame(i / fps, i)) for i in b.column(0).slice(k, 50).to_pylist()]
                yield pa.RecordBatch.from_pylist([{"idx": i, "t": i / fps, "height": m.shape[0], "width": m.shape[1], "channels": 3, "data": m.tobytes()} for i, m in rows], pa.schema([("idx", pa.int64()), ("t", pa.float64()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())]))

    n = round(DURATION * fps) if n is None else n
    return spark.range(0, n, 1, partitions or max(1, n // 100)).mapInArrow(run, "idx long, t double, height int, width int, channels int, data binary")


def schedule_table(spark: SparkSession, schedule: Sequence[tuple] = SCHEDULE) -> DataFrame:
    return spark.createDataFrame([tuple(x) for x in schedule], "key string, start double, `end` double, expected_pattern string")


def active_at(frames: DataFrame, schedule: DataFrame) -> DataFrame:
    """Frames with the schedule's keys that are active: start <= t < end. Bucketed by whole seconds, so that it is an equi-join."""
    s = schedule.selectExpr("*", "explode(sequence(cast(floor(start) as bigint), cast(floor(`end`) as bigint))) as _b")
    return frames.selectExpr("*", "cast(floor(t) as bigint) as _b").join(s, "_b").where("t >= start and t < `end`").drop("_b")


class SyntheticSource(FrameSource):
    """Options: fps, seed, duration."""

    @property
    def fps(self) -> float:
        return float(self.config.get("fps", FPS))

    def frames(self, spark: SparkSession) -> DataFrame:
        return synthetic_frames(spark, round(float(self.config.get("duration", DURATION)) * self.fps), self.fps, int(self.config.get("seed", 7)))


def write_frames(spark: SparkSession, path: str, seed: int = 7, duration: float = DURATION, fps: float = FPS) -> str:
    """The scene as a frame table."""
    synthetic_frames(spark, round(duration * fps), fps, seed).write.mode("overwrite").parquet(path)
    return path
