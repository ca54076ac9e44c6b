"""Scalar functions on text, times and ids, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(c: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def canonical(c: Column) -> Column:
    """Look-alikes become one: O is 0, I is 1."""
    return F.translate(c, "OI", "01")


def text_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length: 0 if equal, 1 if one is empty."""
    return F.when(a == b, 0.0).when((F.length(a) == 0) | (F.length(b) == 0), 1.0).otherwise(F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def wall_time(epoch: Column) -> Column:
    """Local time of epoch seconds; a dash if missing."""
    return F.coalesce(F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd HH:mm:ss"), F.lit("—"))


def offset_time(started: Column, offset: Column) -> Column:
    """Local time at an offset, in whole seconds; empty if the start is missing."""
    return F.coalesce(F.date_format(F.timestamp_seconds(started + offset), "yyyy-MM-dd HH:mm:ss"), F.lit(""))


def session_label(id_: Column, name: Column, started: Column, status: Column) -> Column:
    named = F.when((F.length(name) > 0) & (name != id_), F.concat(F.lit(" ("), name, F.lit(")"))).otherwise("")
    state = F.when(status == "completed", "").otherwise(F.concat(F.lit(" ["), status, F.lit("]")))
    return F.concat(id_, named, F.lit(" · "), wall_time(started), state)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def data_uri(content: Column, path: Column) -> Column:
    """A base64 data URI; null where there is no content."""
    mime = F.when(F.lower(path).endswith(".gif"), "image/gif").otherwise("image/png")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.regexp_replace(F.base64(content), r"\s", ""))


def element_id(text: Column, x: Column, y: Column) -> Column:
    """A HUD element's name: its text, or else its place."""
    return F.coalesce(F.nullif(slugify(text), F.lit("")), F.format_string("elem%dx%d", x, y))


def hud_element_of(anomaly_id: Column) -> Column:
    """The element of a three-part id, else null."""
    parts = F.split(anomaly_id, "/")
    return F.when(F.size(parts) == 3, F.get(parts, F.lit(1)))


def external_urls(html: Column) -> Column:
    """URLs of other hosts that a page would load."""
    found = F.regexp_extract_all(html, F.lit(r"""(?:src|href)\s*=\s*["'](https?://[^"']+)["']"""), F.lit(1))
    return F.filter(found, lambda u: ~u.rlike(r"^https?://(localhost|127\.0\.0\.1)(:|/|$)"))


def square_wave(t: Column, hz: Column) -> Column:
    """True in the first half of each period."""
    return F.pmod((t * hz * 2).cast("long"), F.lit(2)) == 0
