"""Reading and writing overlay text with our own 5 by 7 glyphs."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from wachter.functions.image import component_boxes, otsu, resize_area

#: Our own glyphs, seven rows of five dots each.
GLYPHS = {
    "A": ".###. #...# #...# ##### #...# #...# #...#", "B": "####. #...# #...# ####. #...# #...# ####.", "C": ".#### #.... #.... #.... #.... #.... .####",
    "D": "####. #...# #...# #...# #...# #...# ####.", "E": "##### #.... #.... ####. #.... #.... #####", "F": "##### #.... #.... ####. #.... #.... #....",
    "G": ".#### #.... #.... #..## #...# #...# .####", "H": "#...# #...# #...# ##### #...# #...# #...#", "I": ".###. ..#.. ..#.. ..#.. ..#.. ..#.. .###.",
    "J": "....# ....# ....# ....# ....# #...# .###.", "K": "#...# #..#. #.#.. ##... #.#.. #..#. #...#", "L": "#.... #.... #.... #.... #.... #.... #####",
    "M": "#...# ##.## #.#.# #.#.# #...# #...# #...#", "N": "#...# ##..# ##..# #.#.# #..## #..## #...#", "O": ".###. #...# #...# #...# #...# #...# .###.",
    "P": "####. #...# #...# ####. #.... #.... #....", "Q": ".###. #...# #...# #...# #.#.# #..#. .##.#", "R": "####. #...# #...# ####. #.#.. #..#. #...#",
    "S": ".#### #.... #.... .###. ....# ....# ####.", "T": "##### ..#.. ..#.. ..#.. ..#.. ..#.. ..#..", "U": "#...# #...# #...# #...# #...# #...# .###.",
    "V": "#...# #...# #...# #...# .#.#. .#.#. ..#..", "W": "#...# #...# #...# #.#.# #.#.# ##.## #...#", "X": "#...# #...# .#.#. ..#.. .#.#. #...# #...#",
    "Y": "#...# #...# .#.#. ..#.. ..#.. ..#.. ..#..", "Z": "##### ....# ...#. ..#.. .#... #.... #####", "0": ".###. #...# #...# #...# #...# #...# .###.",
    "1": ".##.. ..#.. ..#.. ..#.. ..#.. ..#.. .###.", "2": ".###. #...# ....# ...#. ..#.. .#... #####", "3": "####. ....# ....# .###. ....# ....# ####.",
    "4": "#..#. #..#. #..#. ##### ...#. ...#. ...#.", "5": "##### #.... ####. ....# ....# ....# ####.", "6": ".###. #.... #.... ####. #...# #...# .###.",
    "7": "##### ....# ...#. ...#. ..#.. ..#.. ..#..", "8": ".###. #...# #...# .###. #...# #...# .###.", "9": ".###. #...# #...# .#### ....# ....# .###.",
}
SIZE = (24, 32)


@lru_cache(1)
def _dots() -> dict[str, np.ndarray]:
    return {c: np.array([[x == "#" for x in row] for row in g.split()]) for c, g in GLYPHS.items()}


def _shape(binary: np.ndarray) -> tuple[np.ndarray, float]:
    """A glyph cut to its ink, in the common size and standardised, and its width by height."""
    ys, xs = np.nonzero(binary)
    ink = binary[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    a = resize_area(ink, *SIZE).ravel()
    a = a - a.mean()
    norm = np.sqrt((a * a).sum())
    return (a / norm if norm > 0 else np.ones_like(a) / np.sqrt(a.size)), ink.shape[1] / ink.shape[0]


@lru_cache(1)
def _templates() -> tuple[list[str], np.ndarray, np.ndarray]:
    shapes = {c: _shape(np.kron(d, np.ones((4, 4), bool))) for c, d in _dots().items()}
    return list(shapes), np.stack([s for s, _ in shapes.values()]), np.array([r for _, r in shapes.values()])


def render(text: str, scale: float = 1.0) -> np.ndarray:
    """A boolean picture of the text; dots are two pixels at scale 1."""
    dots = _dots()
    gap = np.zeros((7, 1), bool)
    parts = [x for c in text.upper() for x in (dots.get(c, np.zeros((7, 4), bool)), gap)][:-1]
    small = np.concatenate(parts, 1) if parts else np.zeros((7, 1), bool)
    h, w = max(7, round(14 * scale)), max(1, round(small.shape[1] * 2 * scale))
    return small[np.arange(h) * 7 // h][:, np.arange(w) * small.shape[1] // w]


def draw_text(img: np.ndarray, text: str, x: int, y: int, scale: float = 1.0, color: int | tuple[int, int, int] = 255) -> None:
    """Text whose lower left corner is x, y; in place, clipped."""
    m = render(text, scale)
    y0 = y - m.shape[0]
    ys, xs = np.nonzero(m)
    ys, xs = ys + y0, xs + x
    ok = (ys >= 0) & (ys < img.shape[0]) & (xs >= 0) & (xs < img.shape[1])
    img[ys[ok], xs[ok]] = color


def read_text(img: np.ndarray, threshold: int | None = None) -> str:
    """Bright text of a gray crop: components at least 6 pixels large and 5 high, from left to right, each the best correlated glyph weighted
    by how alike the proportions are; a gap of more than 0.6 of the median width is a space. Look-alikes O and I come out as 0 and 1."""
    if not img.size:
        return ""
    binary = img > (otsu(img) if threshold is None else threshold)
    boxes = sorted((b for b, area in component_boxes(binary) if area >= 6 and b[3] >= 5), key=lambda b: b[0])
    if not boxes:
        return ""
    names, shapes, ratios = _templates()
    wide, out, right = float(np.median([b[2] for b in boxes])), "", None
    for x, y, w, h in boxes:
        if right is not None and x - right > 0.6 * wide:
            out += " "
        shape, ratio = _shape(binary[y : y + h, x : x + w])
        score = shapes @ shape * np.minimum(ratios, ratio) / np.maximum(ratios, ratio)
        out += names[int(np.argmax(score))]
        right = x + w
    return out.replace("O", "0").replace("I", "1")
