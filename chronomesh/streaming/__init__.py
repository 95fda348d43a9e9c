"""Streaming steps: closed forms on batches, the same state machines on streams."""


def load() -> None:
    """Register the streaming steps."""
    from chronomesh.streaming import steps  # noqa: F401
