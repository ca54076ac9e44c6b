"""Frames from files: Parquet frame tables, or folders of images that the JVM decodes."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wachter.sources import FrameSource, SourceError


def image_frames(spark: SparkSession, path: str, fps: float) -> DataFrame:
    """A folder of numbered images; idx is the last number of the file's name. Images that can't be decoded are dropped."""
    i = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    idx = F.regexp_extract("origin", r"(\d+)\D*$", 1).cast("long")
    return i.select(idx.alias("idx"), (idx / F.lit(fps)).alias("t"), "height", "width", F.col("nChannels").alias("channels"), "data")


def parquet_frames(spark: SparkSession, path: str, fps: float | None = None) -> DataFrame:
    """A frame table (idx, height, width, channels, data[, t]); a given fps sets t anew."""
    f = spark.read.parquet(path)
    t = F.col("idx") / F.lit(float(fps)) if fps else F.col("t")
    return f.select("idx", t.cast("double").alias("t"), "height", "width", "channels", "data")


class FrameFileSource(FrameSource):
    """Options: path (required), format (parquet or image), fps (for images required; overrides a table's), realtime: as a stream of so many
    frames a trigger, see stream()."""

    def __init__(self, config: dict | None = None):
        super().__init__(config)
        if not self.config.get("path"):
            raise SourceError("a frame source needs a path")
        self.path, self.format = str(self.config["path"]), self.config.get("format", "parquet")
        self._fps = float(self.config.get("fps") or 0)
        if self._fps < 0 or (self.format == "image" and not self._fps):
            raise SourceError(f"the frame rate of {self.path} isn't known; set fps")

    @property
    def fps(self) -> float:
        return self._fps

    def frames(self, spark: SparkSession) -> DataFrame:
        try:
            out = image_frames(spark, self.path, self._fps) if self.format == "image" else parquet_frames(spark, self.path, self._fps or None)
        except AnalysisException as e:
            raise SourceError(f"can't open frames at {self.path}") from e
        if not self._fps:
            last = out.agg(F.max_by("idx", "t"), F.max("t")).first()
            self._fps = last[0] / last[1] if last[1] else 0.0
            if self._fps <= 0:
                raise SourceError(f"the frame rate of {self.path} isn't known; set fps")
        return out

    def stream(self, spark: SparkSession, files_per_trigger: int = 1) -> DataFrame:
        """The table as it grows, a few files a trigger."""
        schema = spark.read.parquet(self.path).schema
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(self.path)

    def pace(self, frames_per_file: int, files_per_trigger: int = 1) -> dict:
        """The trigger under which stream() runs no faster than the frames were taken, with realtime; else as fast as it can."""
        if not self.config.get("realtime"):
            return {"availableNow": True}
        if self._fps <= 0:
            raise SourceError("the frame rate isn't known; set fps")
        return {"processingTime": f"{round(1e3 * frames_per_file * files_per_trigger / self._fps)} milliseconds"}
