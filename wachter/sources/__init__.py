"""Frame sources, the table store, and the source contract."""


class SourceError(RuntimeError):
    """A source can't be opened, or its options are wrong."""


class FrameSource:
    """fps, frames(spark) -> DataFrame of wachter.schemas.FRAMES without session_id, close(); a context manager."""

    def __init__(self, config: dict | None = None):
        self.config = dict(config or {})

    @property
    def fps(self) -> float:
        raise NotImplementedError

    def frames(self, spark):
        raise NotImplementedError

    def close(self) -> None:
        pass

    def __enter__(self):
        return self

    def __exit__(self, *exc) -> None:
        self.close()


def source_label(spec: dict) -> str:
    """What a session records as its source: path, or device, or else the class."""
    c = spec.get("config") or {}
    return str(next((c[k] for k in ("path", "device") if c.get(k) is not None), spec.get("class", "")))
