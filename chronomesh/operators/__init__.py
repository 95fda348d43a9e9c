"""Batch operators on event frames."""


def load() -> None:
    """Import all modules, which registers their steps."""
    from chronomesh.operators import context, point_process, spatial, temporal  # noqa: F401
