"""Graphs of spatial units."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, ClassVar, Literal

import numpy as np
from pydantic import BaseModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.adapters.base import MAX_ROWS, BaseModalityAdapter, Output
from chronomesh.frame import EventFrame
from chronomesh.functions.geo import plane_distance
from chronomesh.functions.time import parse_duration, time_floor
from chronomesh.operators.kernels import neighbours
from chronomesh.registry import ADAPTERS

#: Nodes up to which a dense adjacency matrix is made.
MAX_DENSE = 5000


class GraphAdapterConfig(BaseModel):
    node_col: str | None = None
    timestamp_col: str | None = None
    feature_cols: list[str] | None = None
    edge_feature_cols: list[str] | None = None
    adjacency_type: Literal["spatial", "temporal", "both"] = "spatial"
    spatial_threshold: float | None = None
    temporal_window: str | None = None
    include_self_loops: bool = False
    normalize_adjacency: bool = True
    snapshot_interval: str | None = None
    dtype: Literal["float32", "float64"] = "float32"


@dataclass
class GraphSnapshot:
    timestamp: Any
    node_features: np.ndarray
    edge_index: np.ndarray


@dataclass
class GraphOutput(Output):
    node_features: np.ndarray
    edge_index: np.ndarray
    edge_features: np.ndarray | None = None
    adjacency: np.ndarray | None = None
    node_ids: list[Any] = field(default_factory=list)
    feature_names: list[str] = field(default_factory=list)
    edge_feature_names: list[str] = field(default_factory=list)
    snapshots: list[GraphSnapshot] = field(default_factory=list)
    dtypes: dict[str, str] = field(default_factory=dict)
    array_fields: ClassVar[tuple[str, ...]] = ("node_features", "edge_index", "edge_features", "adjacency")

    @property
    def n_nodes(self) -> int:
        return self.node_features.shape[0]

    @property
    def n_edges(self) -> int:
        return self.edge_index.shape[1]

    @property
    def n_features(self) -> int:
        return self.node_features.shape[1]

    @property
    def n_snapshots(self) -> int:
        return len(self.snapshots)

    def arrays(self) -> dict[str, np.ndarray]:
        extra = {"snapshot_features": np.stack([s.node_features for s in self.snapshots])} if self.snapshots else {}
        return super().arrays() | extra

    def plain(self) -> dict[str, Any]:
        return super().plain() | {"snapshots": [s.timestamp for s in self.snapshots]}

    def to_torch_geometric(self) -> Any:
        import torch
        from torch_geometric.data import Data

        weights = None if self.edge_features is None else torch.as_tensor(self.edge_features)
        return Data(x=torch.as_tensor(self.node_features), edge_index=torch.as_tensor(self.edge_index), edge_attr=weights)

    def to_dgl(self) -> Any:
        import dgl
        import torch

        g = dgl.graph((torch.as_tensor(self.edge_index[0]), torch.as_tensor(self.edge_index[1])), num_nodes=self.n_nodes)
        g.ndata["feat"] = torch.as_tensor(self.node_features)
        return g


@ADAPTERS.decorator("graph", tags={"graph", "gnn"}, config_model=GraphAdapterConfig)
class GraphAdapter(BaseModalityAdapter):
    """Nodes with mean features; edges between near centroids, or between touching cells, and in time."""

    config_class, output_class, modality, formats = GraphAdapterConfig, GraphOutput, "graph", ("json",)

    def node(self, source: EventFrame | DataFrame) -> str:
        columns = self.data(source).columns
        found = next((c for c in (self.config.node_col, "grid_id", "zone_id", "cell_id") if c and c in columns), None)
        if found is None:
            raise ValueError("no node column")
        return found

    def nodes(self, source: EventFrame | DataFrame) -> DataFrame:
        """node, n (its number in the order of nodes), mean features (null: 0)."""
        node = self.node(source)
        names = self.features(source, self.config.feature_cols, node)
        rows = self.data(source).where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(*(F.coalesce(F.avg(self.numeric(c)), F.lit(0.0)).alias(c) for c in names or []), F.count("*").alias("_rows"))
        return rows.withColumn("n", F.row_number().over(Window.orderBy("node")) - 1).select("node", "n", *names)  # one row a node

    def edges(self, source: EventFrame | DataFrame) -> DataFrame:
        """src, dst, weight, both ways; with ``normalize_adjacency`` also norm, the weight over the root of both degrees."""
        node, place, df, c = self.node(source), self.place(source), self.data(source), self.config
        found = None
        if c.adjacency_type in ("spatial", "both"):
            if place:
                d = 0.01 if c.spatial_threshold is None else c.spatial_threshold
                centres = df.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.avg(self.numeric(place[0])).alias("x"), F.avg(self.numeric(place[1])).alias("y"))
                far = plane_distance(F.col("x"), F.col("y"), F.col("x_n"), F.col("y_n"))
                pairs = neighbours(centres, "x", "y", d, d, "node").withColumn("_d", far).where((F.col("_d") <= d) & (F.col("node") != F.col("node_n")))
                found = pairs.select(F.col("node").alias("src"), F.col("node_n").alias("dst"), (1 / (F.col("_d") + 1e-6)).alias("weight"))
            else:
                cells = df.where(F.col(node).cast("string").rlike(r"^\d+_\d+$")).select(F.col(node).alias("node")).distinct()
                r, k = (F.split(F.col("node"), "_")[i].cast("int") for i in (0, 1))
                cells = cells.withColumns({"r": r, "k": k})
                step = F.explode(F.array(*(F.struct((F.col("r") + i).alias("r"), (F.col("k") + j).alias("k")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1)))))
                near = cells.select(F.col("node").alias("src"), step.alias("s")).select("src", "s.r", "s.k")
                found = near.join(cells, ["r", "k"]).select("src", F.col("node").alias("dst"), F.lit(1.0).alias("weight"))
        if c.adjacency_type in ("temporal", "both") and c.temporal_window:
            # nodes with events in the same or the next window of time; weight: number of such windows
            width = parse_duration(c.temporal_window)
            seen = df.where(F.col(node).isNotNull()).select(F.col(node).alias("node"), time_floor(self.timestamp(source), c.temporal_window).alias("b")).distinct()
            order = Window.partitionBy("b").orderBy("node")
            chain = seen.withColumn("dst", F.lead("node").over(order)).where("dst is not null").groupBy(F.col("node").alias("src"), "dst").agg((F.count("*") * F.lit(1.0)).alias("weight"))
            both = chain.union(chain.select("dst", "src", "weight")) if width else chain
            found = both if found is None else found.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
        if found is None:
            found = df.select(F.col(node).alias("src"), F.col(node).alias("dst"), F.lit(1.0).alias("weight")).limit(0)
        if c.include_self_loops:
            found = found.union(df.where(F.col(node).isNotNull()).select(F.col(node).alias("a"), F.col(node).alias("b"), F.lit(1.0)).distinct())
        if c.normalize_adjacency:
            degree = found.groupBy(F.col("src").alias("_v")).agg(F.sum("weight").alias("_deg"))
            found = found.join(degree, F.col("src") == F.col("_v")).drop("_v").join(degree.withColumnsRenamed({"_v": "_u", "_deg": "_deg2"}), F.col("dst") == F.col("_u"), "left").drop("_u")
            found = found.withColumn("norm", F.col("weight") / F.sqrt(F.col("_deg") * F.coalesce("_deg2", F.lit(1.0)))).drop("_deg", "_deg2")
        return found

    def snapshots(self, source: EventFrame | DataFrame) -> DataFrame:
        """snapshot, node, mean features, of the nodes that have events in the snapshot; ``convert`` fills in the others with 0."""
        node, names = self.node(source), self.features(source, self.config.feature_cols, self.node(source))
        rows = self.data(source).where(F.col(node).isNotNull()).withColumn("snapshot", time_floor(self.timestamp(source), self.config.snapshot_interval or "1d"))
        means = rows.groupBy("snapshot", F.col(node).alias("node")).agg(*(F.coalesce(F.avg(self.numeric(c)), F.lit(0.0)).alias(c) for c in names), F.count("*").alias("_rows"))
        return means.select("snapshot", "node", *names)

    def convert(self, event_frame: EventFrame | DataFrame) -> GraphOutput:
        nodes = self.gather(self.nodes(event_frame).orderBy("n"))
        names, ids = nodes.column_names[2:], nodes["node"].to_pylist()
        number = {v: i for i, v in enumerate(ids)}
        matrix = lambda t: np.column_stack([t[c].to_numpy() for c in names]).astype(self.dtype) if names else np.zeros((t.num_rows, 0), self.dtype)
        edges = self.gather(self.edges(event_frame).orderBy("src", "dst"))
        index = np.array([[number[v] for v in edges[c].to_pylist()] for c in ("src", "dst")], np.int64).reshape(2, -1)
        weight = edges["weight"].to_numpy().astype(self.dtype)
        dense = None
        if len(ids) <= MAX_DENSE:
            dense = np.zeros((len(ids), len(ids)), self.dtype)
            dense[index[0], index[1]] = edges["norm" if self.config.normalize_adjacency else "weight"].to_numpy()
        shots = []
        if self.config.snapshot_interval:
            table = self.gather(self.snapshots(event_frame).orderBy("snapshot", "node"))
            values, stamps, place = matrix(table), table["snapshot"].to_pylist(), [number[v] for v in table["node"].to_pylist()]
            times = sorted(set(stamps))
            if len(times) * len(ids) > MAX_ROWS:
                raise ValueError(f"more than {MAX_ROWS} nodes in snapshots; use the DataFrame form")
            full = np.zeros((len(times), len(ids), len(names)), self.dtype)
            full[np.searchsorted(np.array(times), np.array(stamps)) if stamps else [], place] = values
            shots = [GraphSnapshot(s, full[k], index) for k, s in enumerate(times)]
        has = bool(self.config.edge_feature_cols)
        return GraphOutput(matrix(nodes), index, weight.reshape(-1, 1) if has else None, dense, ids, names, ["weight"] if has else [], shots, {"node_features": self.dtype, "edge_index": "int64"})

    def restore(self, arrays: dict[str, np.ndarray], plain: dict[str, Any]) -> GraphOutput:
        values, stamps = arrays.pop("snapshot_features", None), plain.pop("snapshots", [])
        out = super().restore(arrays, plain)
        out.edge_index = out.edge_index.reshape(2, -1).astype(np.int64)
        out.snapshots = [] if values is None else [GraphSnapshot(s, v, out.edge_index) for s, v in zip(stamps, values)]
        return out
