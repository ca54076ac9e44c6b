"""Classes by dotted path: sources and detectors are named in the configuration."""

from __future__ import annotations

import pkgutil
from typing import Any


def load_class(path: str) -> type:
    if "." not in path:
        raise ValueError(f"{path!r} is no dotted path of a class")
    module, name = path.rsplit(".", 1)
    try:
        return pkgutil.resolve_name(f"{module}:{name}")
    except AttributeError as e:
        raise ImportError(f"{module} has no {name}") from e


def instantiate(spec: dict) -> Any:
    """The object of {"class": path, "config": {...}}."""
    return load_class(spec["class"])(spec.get("config") or {})
