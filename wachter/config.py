"""Configuration: one YAML file over defaults."""

from __future__ import annotations

import copy
from typing import Any

#: Keys and defaults of a configuration.
DEFAULTS: dict[str, Any] = {
    "session_name": "session",
    "data_dir": "data",
    "video_source": {"class": "wachter.sources.frames.FrameFileSource", "config": {}},
    "calibration": {"duration_seconds": 10.0},
    "detectors": [
        {"class": "wachter.operators.temporal.TemporalDetector", "config": {}},
        {"class": "wachter.operators.hud.HudDetector", "config": {}},
        {"class": "wachter.operators.spatial.SpatialDetector", "config": {}},
    ],
    "aggregation": {
        "cooldown_seconds": 1.0,
        "min_duration_seconds": 0.5,
        "suppression_linger_seconds": 2.5,
        "max_timeline_points": 2000,
        "suppresses": {
            "temporal/flicker": ["*"],
            "temporal/noise": ["temporal/contrast", "hud/*", "spatial/*"],
            "temporal/contrast": ["hud/*", "spatial/*"],
            "hud/*/size": ["hud/*/text", "hud/*/position"],
            "hud/*/position": ["hud/*/text"],
        },
    },
    "media": {"max_clip_seconds": 6.0, "lead_seconds": 1.0, "gif_max_fps": 10.0},
    "report": {"port": 5006, "offline": True, "address": "127.0.0.1"},
    "export": {"format": "html"},
}


def overlay(under: dict, over: dict) -> dict:
    """A new dict: mappings are merged key by key, everything else of over (lists too) replaces."""
    both = {k: (under[k], over[k]) for k in under.keys() & over.keys()}
    merged = {k: overlay(a, b) if isinstance(a, dict) and isinstance(b, dict) else copy.deepcopy(b) for k, (a, b) in both.items()}
    return copy.deepcopy(under) | copy.deepcopy(over) | merged


def merge_defaults(config: dict | None) -> dict:
    return overlay(DEFAULTS, config or {})


def load_config(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        return merge_defaults(yaml.safe_load(f))
