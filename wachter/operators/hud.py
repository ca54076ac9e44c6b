"""HUD detector: text, position, size and blinking of bright overlays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wachter.functions.image import bounding_box, components, dilate, gray
from wachter.functions.ocr import read_text
from wachter.functions.text import text_distance
from wachter.functions.thresholds import robust_thresholds, with_floor_for_missing
from wachter.operators.base import Calibration, Detector, pixels, with_baseline
from wachter.operators.signals import toggle_summary, toggles

#: Of an element's bright pixels, the share that counts as visible in the calibration, whatever visible_fraction says. Fixed value.
_CALIBRATION_SHARE = 0.25
_ELEMENT = "element string, box array<int>, cx double, cy double, area double, pixels int, text string"
_MEASURE = "session_id string, idx long, t double, element string, shown boolean, seen boolean, x int, y int, w int, h int, cx double, cy double, read string"


def find_elements(union: np.ndarray, top: np.ndarray, min_area: int, kernel: int) -> list[dict]:
    """The elements of a session: bright pixels that a dilation joins, by their boxes in order; named by their text or place, with x's
    appended until the name is free."""
    labels, n = components(dilate(union, kernel))
    boxes = []
    for k in range(1, n + 1):
        own = union & (labels == k)
        if own.sum() >= min_area:
            boxes.append(bounding_box(own))
    out: list[dict] = []
    for x, y, w, h in sorted(boxes):
        text = read_text(top[y : y + h, x : x + w])
        name = "".join(filter(str.isalnum, text.lower())) or f"elem{x}x{y}"
        while any(e["element"] == name for e in out):
            name += "x"
        ys, xs = np.nonzero(union[y : y + h, x : x + w])
        out.append({"element": name, "box": [x, y, w, h], "cx": x + float(xs.mean()), "cy": y + float(ys.mean()), "area": float(w * h), "pixels": len(xs), "text": text})
    return out


class HudDetector(Detector):
    name: ClassVar[str] = "hud"
    #: Fixed values.
    defaults: ClassVar[dict] = {
        "bright_threshold": 220, "search_margin": 20, "blink_window_seconds": 2.0, "min_element_area": 15, "merge_kernel": 15, "visible_fraction": 0.25,
        "sigma_k": 8.0, "text_floor": 0.3, "position_floor": 6.0, "size_floor": 0.25, "blink_floor": 2.0,
    }

    def elements(self, frames: DataFrame) -> DataFrame:
        """One row a session and element. Each task reduces its frames to one maximum image a session (a pixel was ever bright if its maximum
        is); only these meet, a few for each session."""
        c = self.config

        def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top: dict[str, np.ndarray] = {}
            for b in batches:
                for r in b.to_pylist():
                    g = gray(pixels(r))
                    top[r["session_id"]] = np.maximum(top[r["session_id"]], g) if r["session_id"] in top else g
            for s, g in top.items():
                yield pa.RecordBatch.from_pylist([{"session_id": s, "height": g.shape[0], "width": g.shape[1], "data": g.tobytes()}], pa.schema([("session_id", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())]))

        def find(got: pa.Table) -> pa.Table:
            rows = got.to_pylist()
            top = np.maximum.reduce([np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"]) for r in rows])
            found = find_elements(top > int(c["bright_threshold"]), top, c["min_element_area"], c["merge_kernel"])
            kinds = pa.schema([("session_id", pa.string()), ("element", pa.string()), ("box", pa.list_(pa.int32())), ("cx", pa.float64()), ("cy", pa.float64()), ("area", pa.float64()), ("pixels", pa.int32()), ("text", pa.string())])
            return pa.Table.from_pylist([{"session_id": rows[0]["session_id"], **e} for e in found], kinds)

        small = frames.mapInArrow(reduce, "session_id string, height int, width int, data binary")
        return small.groupBy("session_id").applyInArrow(find, f"session_id string, {_ELEMENT}")

    def measure(self, frames: DataFrame, elements: DataFrame) -> DataFrame:
        """Each element in each frame: shown (enough bright pixels in its own box), seen (enough near it), and what is bright there: box,
        centroid, text."""
        c = self.config
        packed = elements.groupBy("session_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("element", "box", "pixels")))).alias("_e"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kinds = pa.schema([("session_id", pa.string()), ("idx", pa.int64()), ("t", pa.float64()), ("element", pa.string()), ("shown", pa.bool_()), ("seen", pa.bool_()), *((k, pa.int32()) for k in "xywh"), ("cx", pa.float64()), ("cy", pa.float64()), ("read", pa.string())])
            for b in batches:
                out = []
                for r in b.to_pylist():
                    g = gray(pixels(r))
                    mask, m = g > int(c["bright_threshold"]), int(c["search_margin"])
                    for e in json.loads(r["_e"]):
                        x, y, w, h = e["box"]
                        row = {"session_id": r["session_id"], "idx": r["idx"], "t": r["t"], "element": e["element"], "shown": bool(mask[y : y + h, x : x + w].sum() >= _CALIBRATION_SHARE * e["pixels"])}
                        x0, y0 = max(0, x - m), max(0, y - m)
                        near = mask[y0 : y + h + m, x0 : x + w + m]
                        row["seen"] = bool(near.sum() >= c["visible_fraction"] * e["pixels"] and near.any())
                        if row["seen"]:
                            ys, xs = np.nonzero(near)
                            bx, by, bw, bh = bounding_box(near)
                            row |= {"x": x0 + bx, "y": y0 + by, "w": bw, "h": bh, "cx": x0 + float(xs.mean()), "cy": y0 + float(ys.mean()), "read": read_text(g[y0 + by : y0 + by + bh, x0 + bx : x0 + bx + bw])}
                        out.append(row)
                yield pa.RecordBatch.from_pylist(out, kinds)

        # some elements in JSON
        return with_baseline(frames, packed, 64 << 10).mapInArrow(run, _MEASURE)

    def deviations(self, measured: DataFrame, elements: DataFrame) -> DataFrame:
        e = elements.select("session_id", "element", "box", F.col("cx").alias("_cx"), F.col("cy").alias("_cy"), "area", "text")
        d = measured.join(e, ["session_id", "element"])
        pos, size = F.hypot(F.col("cx") - F.col("_cx"), F.col("cy") - F.col("_cy")), F.abs(F.col("w") * F.col("h") / F.col("area") - 1)
        return d.withColumn("position", F.when(F.col("seen"), pos)).withColumn("size", F.when(F.col("seen"), size)).withColumn("text_dist", F.when(F.col("seen"), text_distance(F.col("read"), F.col("text"))))

    def calibrate(self, frames: DataFrame) -> Calibration:
        c = self.config
        el = self.elements(frames)
        m = self.measure(frames, el)
        shown = m.select("session_id", "element", "t", F.col("shown").alias("visible"))
        base = el.join(toggle_summary(shown), ["session_id", "element"])
        blink = toggles(shown, float(c["blink_window_seconds"]), 0.5).where("filled").join(base.select("session_id", "element", "toggle_rate"), ["session_id", "element"]).select("session_id", "element", F.lit("blink").alias("aspect"), F.abs(F.col("rate") - F.col("toggle_rate")).alias("x"))
        seen = self.deviations(m, el).where("seen").select("session_id", "element", F.expr("stack(3, 'text', text_dist, 'position', position, 'size', size) as (aspect, x)"))
        floor = F.lit(None).cast("double")
        for k in ("text", "position", "size", "blink"):
            floor = F.when(F.col("aspect") == k, float(c[f"{k}_floor"])).otherwise(floor)
        keys = ["session_id", "element", "aspect"]
        ids = el.select("session_id", "element", F.explode(F.array(*map(F.lit, ("text", "position", "size", "blink")))).alias("aspect"))
        thr = with_floor_for_missing(robust_thresholds(seen.union(blink), keys, "x", c["sigma_k"], floor), ids, keys, floor)
        anomaly = F.concat_ws("/", F.lit("hud"), "element", "aspect")
        hz = F.bround(F.col("toggle_rate") / 2, 2)
        notes = base.groupBy("session_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("box", F.col("element").alias("id"), "text", hz.alias("blink_hz"), F.bround("on_ratio", 3).alias("on_ratio")))).alias("hud_elements"))).alias("annotations"))
        meta = ids.join(base, ["session_id", "element"]).select("session_id", anomaly.alias("anomaly_id"), F.to_json(F.struct("element", "text", hz.alias("blink_hz"), F.col("box").alias("calibrated_box"))).alias("metadata"))
        return Calibration(thr.select("session_id", F.lit(self.name).alias("detector"), anomaly.alias("anomaly_id"), "threshold"), base, notes, meta)

    def detect(self, frames: DataFrame, calibration: Calibration) -> DataFrame:
        """Text, position and size are 0 while an element isn't seen; blink is 0 until its window is nearly full. Regions: where it was last
        seen, else its box."""
        el = calibration.baseline
        d = self.deviations(self.measure(frames, el), el)
        blink = toggles(d.select("session_id", "element", "t", F.col("seen").alias("visible")), float(self.config["blink_window_seconds"]), 0.9).select("session_id", "element", "t", "rate", "filled")
        d = d.join(blink, ["session_id", "element", "t"]).join(el.select("session_id", "element", "toggle_rate"), ["session_id", "element"])
        last = F.expr("last(if(seen, struct(x, y, w, h), null), true) over (partition by session_id, element order by t)")
        home = F.struct(*(F.get("box", F.lit(k)).alias(n) for k, n in enumerate("xywh")))
        d = d.withColumn("regions", F.array(F.coalesce(last, home))).withColumn("blink", F.when(F.col("filled"), F.abs(F.col("rate") - F.col("toggle_rate"))).otherwise(0.0))
        zero = lambda k: f"coalesce({k}, 0D)"
        long = d.select("session_id", "t", "element", "regions", F.expr(f"stack(4, 'text', {zero('text_dist')}, 'position', {zero('position')}, 'size', {zero('size')}, 'blink', blink) as (aspect, intensity)"))
        return long.select("session_id", "t", F.concat_ws("/", F.lit("hud"), "element", "aspect").alias("anomaly_id"), "intensity", F.lit(self.name).alias("detector"), "regions")
