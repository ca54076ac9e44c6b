import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wachter import config, plugins
from wachter.functions import image as I
from wachter.functions import names, ocr
from wachter.functions import text as T
from wachter.functions.thresholds import robust_threshold, robust_thresholds, with_floor_for_missing


def test_thresholds(spark):
    rng = random.Random(1)
    groups = {"one": [0.1] * 100 + [50.0], "zero": [0.0] * 50, "normal": [rng.gauss(1, 0.1) for _ in range(200)], "even": [1.0, 2.0, 4.0, 9.0]}
    assert robust_threshold(groups["one"]) == pytest.approx(75.0)
    assert robust_threshold([], floor=2.5) == 2.5
    assert robust_threshold(groups["zero"], floor=3.0) == 3.0
    assert robust_threshold(groups["normal"]) > max(groups["normal"])
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in v], "k string, x double")
    got = with_floor_for_missing(robust_thresholds(df, ["k"]), spark.createDataFrame([(k,) for k in [*groups, "none"]], "k string"), ["k"], 2.5)
    for r in got.collect():
        assert r["threshold"] == pytest.approx(robust_threshold(groups[r["k"]]) if r["k"] in groups else 2.5)


def test_text(spark):
    pairs = [("CAM 01", "ERR 42"), ("abc", "abc"), ("abc", ""), ("", ""), ("!!", "Ä1")]
    r = spark.createDataFrame(pairs, "a string, b string").select(T.text_distance(F.col("a"), F.col("b")), T.slugify(F.col("a")), T.canonical(F.col("a")), T.element_id(F.col("a"), F.lit(3), F.lit(4))).collect()
    assert 0 < r[0][0] <= 1 and [x[0] for x in r[1:4]] == [0, 1, 0]
    assert [x[1] for x in r] == ["cam01", "abc", "abc", "", ""]
    assert r[3][3] == "elem3x4" and r[0][3] == "cam01"
    one = spark.range(1).select(T.html_escape(F.lit("<a href=\"x\">&'")), T.wall_time(F.lit(None).cast("double")), T.offset_time(F.lit(0.0), F.lit(1.9)), T.external_urls(F.lit("<img src='https://cdn.x/y.js'><a href=\"http://localhost:1/\">")), T.data_uri(F.lit(b"abc"), F.lit("x.GIF"))).first()
    assert tuple(one) == ("&lt;a href=&quot;x&quot;&gt;&amp;&#x27;", "—", "1970-01-01 00:00:01", ["https://cdn.x/y.js"], "data:image/gif;base64,YWJj")
    lab = spark.range(1).select(T.session_label(F.lit("A"), F.lit("n"), F.lit(0.0), F.lit("running")), T.session_label(F.lit("A"), F.lit("A"), F.lit(0.0), F.lit("completed"))).first()
    assert lab[0] == "A (n) · 1970-01-01 00:00:00 [running]" and lab[1] == "A · 1970-01-01 00:00:00"


def test_names():
    assert "-" in names.generate_session_id()
    every = {f"{a}-{n}" for a in names.ADJECTIVES for n in names.NOUNS}
    assert names.generate_session_id(every).count("-") == 2


def test_config(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("session_name: x\naggregation: {cooldown_seconds: 3}\ndetectors: []\n")
    c = config.load_config(str(p))
    assert c["aggregation"]["cooldown_seconds"] == 3 and c["aggregation"]["min_duration_seconds"] == 0.5 and c["detectors"] == [] and config.DEFAULTS["detectors"]
    (tmp_path / "e.yaml").write_text("")
    assert config.load_config(str(tmp_path / "e.yaml")) == config.DEFAULTS


def test_plugins():
    d = plugins.instantiate({"class": "wachter.operators.hud.HudDetector", "config": {"merge_kernel": 3}})
    assert d.config["merge_kernel"] == 3 and d.config["sigma_k"] == 8.0
    with pytest.raises(ValueError):
        plugins.load_class("Nothing")
    with pytest.raises(ImportError):
        plugins.load_class("wachter.config.Nothing")


def test_components_and_dilation():
    rng = np.random.default_rng(2)
    for _ in range(20):
        m = rng.random((12, 17)) < 0.3
        labels, n = I.components(m)
        seen = np.zeros_like(m)
        count = 0
        for y, x in np.argwhere(m):
            if seen[y, x]:
                continue
            count += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < 12 and 0 <= b < 17 and m[a, b] and not seen[a, b]:
                    seen[a, b] = True
                    assert labels[a, b] == labels[y, x]
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        assert n == count and ((labels > 0) == m).all()
    m = np.zeros((9, 9), bool)
    m[4, 4] = True
    assert I.dilate(m, 3).sum() == 9 and I.dilate(m, 5)[2:7, 2:7].all() and I.dilate(m, 5).sum() == 25


def test_otsu_resize_ocr():
    img = np.full((20, 20), 40, np.uint8)
    img[5:10] = 200
    assert 40 <= I.otsu(img) < 200
    assert I.resize_area(np.arange(16.0).reshape(4, 4), 2, 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]
    rng = np.random.default_rng(0)
    for text in ("CAM01", "REC", "TEMP22", "ERR42", "CAM 01"):
        a = np.full((60, 200), 90, np.uint8)
        ocr.draw_text(a, text, 10, 40)
        assert ocr.read_text(np.clip(a + rng.normal(0, 4, a.shape), 0, 255).astype(np.uint8)) == text
    assert ocr.read_text(np.zeros((5, 5), np.uint8)) == ""


def test_tracking():
    rng = np.random.default_rng(1)
    img = np.clip(128 + np.kron(rng.normal(size=(24, 32)) * 40, np.ones((10, 10))), 0, 255).astype(np.uint8)
    p = I.good_corners(img, 60, 0.03, 7)
    assert len(p) == 60 and min(np.hypot(*(a - b)) for i, a in enumerate(p) for b in p[:i]) >= 7
    m = I.rotation(160, 120, 2, 1.0)
    q, ok = I.track(I.pyramid(img, 3), I.pyramid(I.warp(img, m), 3), p)
    want = p @ m[:, :2].T + m[:, 2]
    assert ok.mean() > 0.9 and np.median(np.abs(q - want)[ok]) < 0.3


def gif_pixels(raw):
    """A plain GIF reader: each frame's colour numbers."""
    i, frames = 13 + 768, []
    while raw[i] != 0x3B:
        if raw[i] == 0x21:
            i += 2
        else:
            w = int.from_bytes(raw[i + 5 : i + 7], "little")
            bits, i = raw[i + 10], i + 11
            body = b""
            while n := raw[i]:
                body += raw[i + 1 : i + 1 + n]
                i += n + 1
            i += 1
            clear, size, table, pos, out, old = 1 << bits, bits + 1, None, 0, [], None
            stream = int.from_bytes(body, "little")
            while True:
                code = (stream >> pos) & ((1 << size) - 1)
                pos += size
                if code == clear:
                    table, size, old = [bytes([k]) for k in range(clear)] + [b"", b""], bits + 1, None
                    continue
                if code == clear + 1:
                    break
                word = table[code] if code < len(table) else old + old[:1]
                out.append(word)
                if old is not None and len(table) < 4096:
                    table.append(old + word[:1])
                    if len(table) == 1 << size and size < 12:
                        size += 1
                old = word
            frames.append(np.frombuffer(b"".join(out), np.uint8).reshape(-1, w))
            continue
        while n := raw[i]:
            i += n + 1
        i += 1
    return frames


def test_gif_and_png():
    rng = np.random.default_rng(3)
    frames = [rng.integers(0, 256, (50, 60, 3), np.uint8), np.zeros((50, 60, 3), np.uint8), rng.integers(0, 256, (50, 60, 3), np.uint8)]
    for got, f in zip(gif_pixels(I.gif(frames, 10)), frames, strict=True):
        q = np.rint(f[..., ::-1].astype(np.float32) * (5 / 255)).astype(int)
        assert (got == q[..., 0] * 36 + q[..., 1] * 6 + q[..., 2]).all()
    assert I.png(frames[0])[:8] == b"\x89PNG\r\n\x1a\n"
    with pytest.raises(ValueError):
        I.gif([], 10)
