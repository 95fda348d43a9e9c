"""Adapters from event frames to model-ready forms."""


def load() -> None:
    """Register the adapters."""
    from chronomesh.adapters import graph, raster, sequence, stream, table  # noqa: F401
