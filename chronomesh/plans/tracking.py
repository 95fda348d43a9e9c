"""Recording of runs: every event is one record, and a store decides where it goes."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from pathlib import Path
from typing import Any, Protocol, runtime_checkable

#: A record: its kind and its fields.
Store = Callable[[str, dict[str, Any]], None]
#: The kinds of records and their fields, in the order in which they are given.
FIELDS = {
    "param": ("key", "value"),
    "metric": ("key", "value", "step"),
    "artifact": ("local_path", "artifact_path"),
    "tags": ("tags",),
    "dict": ("dictionary", "artifact_file"),
}
#: The calls by which users of trackers record, and the kinds that they make.
CALLS = {"log_param": "param", "log_metric": "metric", "log_artifact": "artifact", "set_tags": "tags", "log_dict": "dict"}


@runtime_checkable
class TrackerProtocol(Protocol):
    """Anything that takes records; :class:`Tracker` has the five named calls on top."""

    def record(self, kind: str, **fields: Any) -> None: ...


class Tracker:
    """Records checked against FIELDS and handed to a store; the calls are made from one table."""

    def __init__(self, store: Store):
        self._store = store

    def record(self, kind: str, **fields: Any) -> None:
        if odd := set(fields) - set(FIELDS[kind]):
            raise TypeError(f"unknown fields of a {kind}: {sorted(odd)}")
        self._store(kind, dict.fromkeys(FIELDS[kind]) | fields)

    def __getattr__(self, name: str) -> Callable[..., None]:
        if name not in CALLS:
            raise AttributeError(name)
        kind = CALLS[name]
        return lambda *values, **named: self.record(kind, **dict(zip(FIELDS[kind], values)), **named)


class JsonLinesTracker(Tracker):
    """Every record a line of JSON."""

    def __init__(self, path: str | Path):
        self.path = Path(path)
        super().__init__(self._append)

    def _append(self, kind: str, fields: dict[str, Any]) -> None:
        with self.path.open("a") as f:
            f.write(json.dumps({"time": time.time(), "kind": kind, **fields}, default=str) + "\n")


class MLflowTracker(Tracker):
    """Records into a run of an MLflow experiment, which is a context; ImportError without MLflow."""

    def __init__(self, experiment_name: str, tracking_uri: str | None = None, run_name: str | None = None):
        from mlflow import MlflowClient

        self.client = MlflowClient(tracking_uri)
        known = self.client.get_experiment_by_name(experiment_name)
        self.experiment = known.experiment_id if known else self.client.create_experiment(experiment_name)
        self.run_name, self.run = run_name, None
        super().__init__(self._send)

    def __enter__(self) -> MLflowTracker:
        self.run = self.client.create_run(self.experiment, run_name=self.run_name).info.run_id
        return self

    def __exit__(self, failed: type | None, *_: Any) -> None:
        self.client.set_terminated(self.run, "FAILED" if failed else "FINISHED")

    def _send(self, kind: str, fields: dict[str, Any]) -> None:
        if self.run is None:
            raise RuntimeError("records go into a run: use the tracker as a context")
        if kind == "tags":
            for key, value in fields["tags"].items():
                self.client.set_tag(self.run, key, value)
            return
        getattr(self.client, f"log_{kind}")(self.run, *(v for v in fields.values() if v is not None))
