"""Image operators on NumPy arrays, used inside Arrow functions. Public algorithms; see each function."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

Box = tuple[int, int, int, int]


def gray(image: np.ndarray) -> np.ndarray:
    """Luma of BGR bytes (ITU-R BT.601 weights), rounded to bytes."""
    if image.ndim == 2 or image.shape[2] == 1:
        return image.reshape(image.shape[:2])
    b, g, r = (image[..., k].astype(np.float32) for k in range(3))
    return np.rint(0.114 * b + 0.587 * g + 0.299 * r).astype(np.uint8)


def dilate(mask: np.ndarray, k: int) -> np.ndarray:
    """Maximum over a k by k square, one axis after the other."""
    out = mask.astype(bool)
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (k // 2, k - 1 - k // 2)
        out = sliding_window_view(np.pad(out, pad), k, axis).any(-1)
    return out


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """8-connected components: labels from 1 in the order of their first pixels, and their number. Runs of pixels by row are merged."""
    m = np.pad(mask.astype(bool), ((0, 0), (1, 1)))
    rows, begin = np.nonzero(m[:, 1:-1] & ~m[:, :-2])
    end = np.nonzero(m[:, 1:-1] & ~m[:, 2:])[1]
    up = np.arange(len(rows))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    first = np.searchsorted(rows, np.arange(mask.shape[0] + 1))
    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if begin[i] <= end[j] + 1 and begin[j] <= end[i] + 1:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
            if end[i] < end[j]:
                i += 1
            else:
                j += 1
    label = np.unique([top(i) for i in range(len(rows))], return_inverse=True)[1] + 1 if len(rows) else np.zeros(0, int)
    out = np.zeros(mask.shape, np.int32)
    for y, x0, x1, v in zip(rows, begin, end, label, strict=True):
        out[y, x0 : x1 + 1] = v
    return out, int(label.max()) if len(label) else 0


def bounding_box(mask: np.ndarray) -> Box:
    ys, xs = np.nonzero(mask)
    return int(xs.min()), int(ys.min()), int(np.ptp(xs)) + 1, int(np.ptp(ys)) + 1


def component_boxes(mask: np.ndarray) -> list[tuple[Box, int]]:
    """(box, pixels) of each component."""
    labels, n = components(mask)
    ys, xs = np.nonzero(labels)
    v = labels[ys, xs] - 1
    lo, hi = np.full((n, 2), 1 << 30), np.zeros((n, 2), int)
    for k, c in enumerate((xs, ys)):
        np.minimum.at(lo[:, k], v, c)
        np.maximum.at(hi[:, k], v, c)
    area = np.bincount(v, minlength=n)
    return [((int(a), int(b), int(c - a + 1), int(d - b + 1)), int(s)) for (a, b), (c, d), s in zip(lo, hi, area, strict=True)]


def otsu(img: np.ndarray) -> int:
    """The level that parts the histogram with the greatest variance between both sides (Otsu 1979)."""
    h = np.bincount(img.ravel(), minlength=256).astype(float)
    w, m = np.cumsum(h), np.cumsum(h * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - m * w[-1]) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def _area_matrix(n: int, m: int) -> np.ndarray:
    """Row i averages the source cells that output cell i covers, by overlap."""
    edge = np.arange(m + 1) * n / m
    cell = np.arange(n)
    over = np.minimum(edge[1:, None], cell + 1) - np.maximum(edge[:-1, None], cell)
    over = np.clip(over, 0, None)
    return over / over.sum(1, keepdims=True)


def resize_area(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """Area-averaging resize, in floats."""
    a, b = _area_matrix(img.shape[0], height), _area_matrix(img.shape[1], width)
    return np.einsum("ij,jk...,lk->il...", a, img.astype(float), b)


def warp(img: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Affine warp with bilinear sampling and mirrored borders. matrix maps source to target."""
    h, w = img.shape[:2]
    inv = np.linalg.inv(np.vstack([matrix, [0, 0, 1]]))
    ys, xs = np.mgrid[:h, :w]
    x, y, _ = np.tensordot(inv, np.stack([xs, ys, np.ones_like(xs)]), 1)
    fold = lambda v, n: np.abs((v + n) % (2 * n) - n) if n > 1 else v * 0
    return sample(img, fold(x + 0.5, w) - 0.5, fold(y + 0.5, h) - 0.5)


def rotation(cx: float, cy: float, degrees: float, scale: float) -> np.ndarray:
    """Rotation about a point, counter-clockwise on a screen, with a zoom."""
    a = np.deg2rad(degrees)
    c, s = scale * np.cos(a), scale * np.sin(a)
    return np.array([[c, s, (1 - c) * cx - s * cy], [-s, c, s * cx + (1 - c) * cy]])


def sample(img: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear; coordinates outside take the border's pixels."""
    h, w = img.shape[:2]
    x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.minimum(x.astype(int), max(w - 2, 0)), np.minimum(y.astype(int), max(h - 2, 0))
    x1, y1 = np.minimum(x0 + 1, w - 1), np.minimum(y0 + 1, h - 1)
    fx, fy = x - x0, y - y0
    if img.ndim == 3:
        fx, fy = fx[..., None], fy[..., None]
    return (img[y0, x0] * (1 - fx) + img[y0, x1] * fx) * (1 - fy) + (img[y1, x0] * (1 - fx) + img[y1, x1] * fx) * fy


def _box_sum(a: np.ndarray, r: int) -> np.ndarray:
    for axis in (0, 1):
        pad = [(0, 0), (0, 0)]
        pad[axis] = (r, r)
        a = sliding_window_view(np.pad(a, pad, mode="reflect"), 2 * r + 1, axis).sum(-1)
    return a


def _gradients(img: np.ndarray, smooth: tuple[float, float, float]) -> tuple[np.ndarray, np.ndarray]:
    p = np.pad(img.astype(np.float32), 1, mode="edge")
    a, b, c = smooth
    dx, dy = p[:, 2:] - p[:, :-2], p[2:] - p[:-2]
    return a * dx[:-2] + b * dx[1:-1] + c * dx[2:], a * dy[:, :-2] + b * dy[:, 1:-1] + c * dy[:, 2:]


def good_corners(img: np.ndarray, most: int, quality: float, distance: float, mask: np.ndarray | None = None) -> np.ndarray:
    """Shi-Tomasi corners (x, y), the strongest first, at least distance apart: local maxima of the smaller eigenvalue of the 3 by 3
    structure tensor, down to a share of the best."""
    gx, gy = _gradients(img, (1, 2, 1))
    xx, yy, xy = _box_sum(gx * gx, 1), _box_sum(gy * gy, 1), _box_sum(gx * gy, 1)
    small = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    if mask is not None:
        small = np.where(mask, small, 0)
    peak = sliding_window_view(np.pad(small, 1, constant_values=-1), (3, 3)).max((-1, -2))
    ok = (small == peak) & (small > max(quality * small.max(), 0))
    ok[[0, -1]] = False
    ok[:, [0, -1]] = False
    ys, xs = np.nonzero(ok)
    order = np.argsort(-small[ys, xs], kind="stable")
    free = np.ones(img.shape, bool)
    r = int(np.ceil(distance))
    dy, dx = np.mgrid[-r : r + 1, -r : r + 1]
    disc = dx * dx + dy * dy < distance * distance
    kept: list[tuple[int, int]] = []
    for y, x in zip(ys[order], xs[order], strict=True):
        if len(kept) == most:
            break
        if free[y, x]:
            kept.append((x, y))
            y0, x0 = max(0, y - r), max(0, x - r)
            part = free[y0 : y + r + 1, x0 : x + r + 1]
            part &= ~disc[y0 - y + r : y0 - y + r + part.shape[0], x0 - x + r : x0 - x + r + part.shape[1]]
    return np.array(kept, np.float32).reshape(-1, 2)


def pyramid(img: np.ndarray, levels: int) -> list[np.ndarray]:
    """The image and its halvings, smoothed by (1 4 6 4 1) / 16."""
    out, k = [img.astype(np.float32)], np.array([1, 4, 6, 4, 1], np.float32) / 16
    for _ in range(levels):
        a = out[-1]
        if min(a.shape) < 8:
            break
        for axis in (0, 1):
            pad = [(0, 0), (0, 0)]
            pad[axis] = (2, 2)
            a = sliding_window_view(np.pad(a, pad, mode="reflect"), 5, axis) @ k
        out.append(a[::2, ::2])
    return out


def track(a: list[np.ndarray], b: list[np.ndarray], points: np.ndarray, window: int = 21, steps: int = 30, eps: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """Pyramidal Lucas-Kanade (Bouguet 2001): where the points of a are in b, and which are found. All points at once."""
    r = window // 2
    oy, ox = (o.astype(np.float32) for o in np.mgrid[-r : r + 1, -r : r + 1])
    flow, good = np.zeros_like(points, np.float64), np.ones(len(points), bool)
    for level in range(len(a) - 1, -1, -1):
        src, dst = a[level], b[level]
        p = points / 2.0**level
        flow = flow * 2 if level < len(a) - 1 else flow
        x, y = p[:, 0, None, None] + ox, p[:, 1, None, None] + oy
        gx, gy = (g / 32 for g in _gradients(src, (3, 10, 3)))
        tx, ty, here = sample(gx, x, y), sample(gy, x, y), sample(src, x, y)
        xx, yy, xy = (tx * tx).sum((1, 2)), (ty * ty).sum((1, 2)), (tx * ty).sum((1, 2))
        det = xx * yy - xy * xy
        strong = ((xx + yy - np.sqrt((xx - yy) ** 2 + 4 * xy * xy)) / (2 * window * window) > 1e-4) & (det > 1e-9)
        if level == 0:
            good &= strong
        live = np.flatnonzero(strong)
        for _ in range(steps):
            if not len(live):
                break
            diff = here[live] - sample(dst, x[live] + flow[live, 0, None, None], y[live] + flow[live, 1, None, None])
            bx, by = (diff * tx[live]).sum((1, 2)), (diff * ty[live]).sum((1, 2))
            step = np.stack([yy[live] * bx - xy[live] * by, xx[live] * by - xy[live] * bx], 1) / det[live, None]
            flow[live] += step
            live = live[(step * step).sum(1) > eps * eps]
    end = points + flow
    h, w = a[0].shape
    return end, good & (end[:, 0] >= -r) & (end[:, 0] < w + r) & (end[:, 1] >= -r) & (end[:, 1] < h + r)


# --- encoders and drawing ---------------------------------------------------------------------------


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB PNG."""
    h, w = rgb.shape[:2]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, -1)], 1).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


#: Colours of our GIFs: 6 levels of each channel.
_LEVELS = 6


def _lzw(codes: bytes, bits: int = 8) -> bytes:
    """GIF's variable-length LZW."""
    clear, stop = 1 << bits, (1 << bits) + 1
    out, acc, n = bytearray(), 0, 0
    table: dict[tuple[int, int], int] = {}
    size, free = bits + 1, stop + 1

    def put(code: int) -> None:
        nonlocal acc, n
        acc |= code << n
        n += size
        while n >= 8:
            out.append(acc & 255)
            acc >>= 8
            n -= 8

    put(clear)
    held = -1
    for c in codes:
        if held < 0:
            held = c
        elif (got := table.get((held, c))) is not None:
            held = got
        else:
            put(held)
            if free < 4096:
                table[held, c] = free
                if free == 1 << size and size < 12:
                    size += 1
                free += 1
            else:
                put(clear)
                table.clear()
                size, free = bits + 1, stop + 1
            held = c
    if held >= 0:
        put(held)
    put(stop)
    if n:
        out.append(acc & 255)
    return bytes(out)


def gif(frames: list[np.ndarray], fps: float) -> bytes:
    """An endless animated GIF of BGR frames, int(1000 / fps) ms each (in GIF's hundredths), in a fixed palette. No frames: ValueError."""
    if not frames:
        raise ValueError("a GIF needs at least one frame")
    h, w = frames[0].shape[:2]
    level = np.linspace(0, 255, _LEVELS).round().astype(np.uint8)
    palette = np.zeros((256, 3), np.uint8)
    palette[: _LEVELS**3] = np.stack(np.meshgrid(level, level, level, indexing="ij"), -1).reshape(-1, 3)
    out = [b"GIF89a" + struct.pack("<HHBBB", w, h, 0xF7, 0, 0) + palette.tobytes(), b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00"]
    delay = max(1, int(1000 / fps) // 10)
    for f in frames:
        q = np.rint(f[..., ::-1].astype(np.float32) * ((_LEVELS - 1) / 255)).astype(np.int64)
        body = _lzw((q[..., 0] * _LEVELS**2 + q[..., 1] * _LEVELS + q[..., 2]).astype(np.uint8).tobytes())
        out.append(b"\x21\xf9\x04\x00" + struct.pack("<H", delay) + b"\x00\x00\x2c" + struct.pack("<HHHHB", 0, 0, w, h, 0) + b"\x08")
        out += [bytes([len(body[i : i + 255])]) + body[i : i + 255] for i in range(0, len(body), 255)]
        out.append(b"\x00")
    return b"".join(out) + b"\x3b"


def draw_box(img: np.ndarray, box: Box, color: tuple[int, int, int]) -> None:
    """The outline of a box, clipped to the image; in place."""
    h, w = img.shape[:2]
    x0, y0, x1, y1 = box[0], box[1], box[0] + box[2], box[1] + box[3]
    inside = lambda a, b, n: slice(max(0, a), max(0, min(n, b + 1)))
    for y in (y0, y1):
        if 0 <= y < h:
            img[y, inside(x0, x1, w)] = color
    for x in (x0, x1):
        if 0 <= x < w:
            img[inside(y0, y1, h), x] = color


def draw_line(img: np.ndarray, a: tuple[int, int], b: tuple[int, int], color: tuple[int, int, int], width: int = 1) -> None:
    n = max(abs(b[0] - a[0]), abs(b[1] - a[1]), 1)
    x, y = (np.rint(np.linspace(p, q, n + 1)).astype(int) for p, q in zip(a, b, strict=True))
    for k in range(width):
        ok = (x >= 0) & (x < img.shape[1]) & (y + k >= 0) & (y + k < img.shape[0])
        img[y[ok] + k, x[ok]] = color
