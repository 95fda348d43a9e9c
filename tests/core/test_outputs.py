"""Adapters: shapes, contents and round trips; validators; joiners and sources."""

import json
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronomesh.adapters.graph import GraphAdapter
from chronomesh.adapters.raster import RasterAdapter
from chronomesh.adapters.sequence import SequenceAdapter
from chronomesh.adapters.stream import StreamAdapter
from chronomesh.adapters.table import TableAdapter
from chronomesh.operators import context as C
from chronomesh.operators import validation as V
from chronomesh.schema import ContextSchema
from chronomesh.sources.context import DemographicsSource, StaticSpatialSource, StaticTemporalSource, WeatherSource
from tests.conftest import START


@pytest.fixture(scope="module")
def grid(make):
    """Three by three cells over five days, a row each, and a second row that must win."""
    rows = [{"ts": START + timedelta(days=d), "value": float(d * 9 + r * 3 + c), "kind": "ABC"[c], "cell": f"{r}_{c}"} for d in range(5) for r in range(3) for c in range(3)]
    rows.append({**rows[-1], "value": 100.0})
    f = make(rows)
    return f.with_columns(grid_id=F.concat_ws("_", F.floor(F.col("id") % 9 / 3).cast("int").cast("string"), (F.col("id") % 3).cast("string"))).filter(F.col("id") < 45)


ADAPTERS = {
    "table": (lambda: TableAdapter(feature_cols=["value", "user"], target_col="user", index_cols=["id"]), ["numpy", "parquet", "arrow"]),
    "sequence": (lambda: SequenceAdapter(feature_cols=["value"], time_encoding="positional"), ["numpy", "arrow"]),
    "raster": (lambda: RasterAdapter(feature_cols=["value"]), ["numpy", "arrow"]),
    "graph": (lambda: GraphAdapter(feature_cols=["value"], snapshot_interval="1d"), ["numpy", "json"]),
    "stream": (lambda: StreamAdapter(state_cols=["value"], event_type_col="kind"), ["numpy", "json", "parquet"]),
}


@pytest.mark.parametrize("name", ADAPTERS)
def test_round_trips(grid, tmp_path, name):
    build, formats = ADAPTERS[name]
    adapter = build()
    out = adapter.convert(grid)
    meta = adapter.get_metadata(out)
    assert json.loads(json.dumps(meta)) == meta and {k: tuple(v["shape"]) for k, v in meta["arrays"].items()} == {k: v.shape for k, v in out.arrays().items()}
    for fmt in formats:
        path = adapter.serialize(out, tmp_path / f"{name}.{fmt}", fmt)
        back = adapter.deserialize(path, fmt)
        for k, v in out.arrays().items():
            assert np.array_equal(back.arrays()[k], v) if v.dtype.kind in "US" else np.allclose(back.arrays()[k].astype(float), v.astype(float)), (fmt, k)
    with pytest.raises(ValueError):
        adapter.serialize(out, tmp_path / "x", "pickle")
    with pytest.raises(ImportError):
        adapter.serialize(out, tmp_path / "x", "pytorch")
    assert adapter.describe()


def test_table(grid):
    out = TableAdapter(include_intercept=True, feature_cols=["value"], target_col="user", index_cols=["id"]).convert(grid)
    assert out.feature_names == ["_intercept", "value"] and out.to_numpy().shape == (45, 2) and out.to_numpy(True).shape == (45, 3)
    x, y = out.get_X_y()
    assert x.dtype == np.float32 and len(y) == 45 and out.to_pandas().index.name == "id"


def test_sequence(grid):
    out = SequenceAdapter(feature_cols=["value"], sequence_length=7, padding_side="left", padding_value=-1.0).convert(grid)
    assert out.sequences.shape == (9, 7, 1) and out.lengths.tolist() == [5] * 9
    assert out.sequences[0, :2, 0].tolist() == [-1, -1] and out.masks[0].tolist() == [False] * 2 + [True] * 5
    cut = SequenceAdapter(feature_cols=["value"], sequence_length=3).convert(grid)
    assert cut.sequences[4, :, 0].tolist() == [4, 13, 22] and cut.lengths[4] == 5
    rows = SequenceAdapter(feature_cols=["value"], sequence_length=7, padding_side="left", padding_value=-1.0).arrays_frame(grid).orderBy("unit").collect()
    assert np.allclose(np.array([r["values"] for r in rows]), out.sequences) and [r["mask"] for r in rows] == out.masks.tolist()
    assert SequenceAdapter(feature_cols=["value"], time_encoding="sinusoidal").convert(grid).time_encoding.shape == (5, 16)
    with pytest.raises(ValueError):
        SequenceAdapter().convert(grid.df.drop("grid_id"))


def test_raster(grid):
    out = RasterAdapter(feature_cols=["value"]).convert(grid)
    assert out.raster.shape == (5, 1, 3, 3) and out.raster[1, 0, 2, 1] == 16 and (out.height, out.width, out.n_channels, out.n_timesteps) == (3, 3, 1, 5)
    last = RasterAdapter(feature_cols=["value"], time_steps=2, channel_first=False, grid_shape=(2, 3), normalize=True).convert(grid)
    assert last.raster.shape == (2, 2, 3, 1) and abs(last.raster.mean()) < 1e-6 and last.to_tensorflow() is last.raster
    twice = grid.with_df(grid.df.unionByName(grid.df.where("id = 4").withColumns({"id": F.lit(99).cast("long"), "value": F.lit(77.0)})))
    assert RasterAdapter(feature_cols=["value"]).convert(twice).raster[0, 0, 1, 1] == 77


def test_graph(grid):
    plain = grid.df.drop("lat", "lon").withColumnRenamed("ts", "timestamp")
    out = GraphAdapter(feature_cols=["value"], normalize_adjacency=False).convert(plain)
    assert out.n_nodes == 9 and out.n_edges == 24 and out.adjacency.sum() == 24 and out.node_features[0, 0] == np.mean([0, 9, 18, 27, 36])
    looped = GraphAdapter(feature_cols=["value"], include_self_loops=True, edge_feature_cols=["w"]).convert(plain)
    assert looped.n_edges == 33 and looped.edge_features.shape == (33, 1) and np.allclose(looped.adjacency, looped.adjacency.T)
    near = GraphAdapter(feature_cols=["value"], spatial_threshold=100.0).convert(grid)
    assert near.n_edges == 72
    shots = GraphAdapter(feature_cols=["value"], snapshot_interval="1d").convert(plain)
    assert shots.n_snapshots == 5 and shots.snapshots[2].node_features[3, 0] == 21
    timed = GraphAdapter(feature_cols=["value"], adjacency_type="temporal", temporal_window="1d").convert(plain)
    assert timed.n_edges == 16


def test_stream(grid):
    out = StreamAdapter(state_cols=["value"], event_type_col="kind", dtype="float64").convert(grid)
    assert out.n_events == 45 and out.timestamps[-1] == 4 * 86400 and out.inter_times[0] == 0 and out.inter_times.sum() == 4 * 86400
    assert out.event_type_names == ["A", "B", "C"] and len(out.get_sequences_by_type()[1][0]) == 15 and out.get_sequences_by_type()[1][1].shape == (15, 1)
    whole = StreamAdapter(state_cols=["value"]).convert(grid).get_sequences_by_type()
    assert list(whole) == [0] and len(whole[0][0]) == 45 and whole[0][1].shape == (45, 1)
    some = StreamAdapter(state_cols=["value"], max_events=10, time_scale="normalize", dtype="float64").convert(grid)
    assert some.n_events == 10 and abs(some.timestamps.mean()) < 1e-9 and abs(some.timestamps.std() - 1) < 1e-9
    late = StreamAdapter(state_cols=["value"], time_origin="custom", custom_origin="2024-01-01T00:00:10", time_scale="log", dtype="float64").convert(grid)
    assert late.origin == 1704067210 and abs(late.timestamps[0] - np.log1p(1)) < 1e-12


def test_validators(make):
    good = make([{"value": v} for v in (1.0, 0.8, 0.8, 0.0)])
    bad = make([{"value": v} for v in (1.2, 0.9, 1.0, -0.1)])
    for check in (V.validate_intensity_positivity, V.validate_probability_bounds, V.validate_survival_monotonicity, V.validate_survival_boundaries, V.validate_hazard_positivity):
        assert check(good, "value").is_valid, check
    for check in (V.validate_intensity_positivity, V.validate_probability_bounds, V.validate_survival_monotonicity, V.validate_survival_boundaries):
        assert not check(bad, "value").is_valid, check
    assert not V.validate_inter_event_positivity(good, "value").is_valid and V.validate_inter_event_positivity(good, "value", True).is_valid
    assert V.validate_intensity_integrability(good, "value").details["integral"] == 3600 * (0.9 + 0.8 + 0.4)
    assert not V.validate_intensity_integrability(good, "value", 1.0).is_valid
    warning = V.validate_cumulative_hazard_start(make([{"value": -1.0}]), "value")
    assert not warning.is_valid and warning.severity == "warning"
    report = V.ValidationReport([warning])
    assert report.is_valid and report.warnings and "warning" in report.summary()
    assert not V.validate_intensity_positivity(good, "nothing").is_valid
    assert V.validate_hawkes_stability(0.5, 1.0).is_valid and not V.validate_hawkes_stability(2, 1).is_valid and not V.validate_hawkes_stability(1, 0).is_valid
    both = make([{}]).with_columns(hawkes_intensity=F.lit(0.05), hawkes_background=F.lit(0.1))
    assert not V.validate_hawkes_features(both, 0.5, 1.0).is_valid
    assert V.validate_temporal_ordering(good).is_valid
    assert not V.validate_temporal_ordering(make([{"ts": START + timedelta(hours=-i)} for i in range(3)])).is_valid
    assert len(V.validate_point_process_features(good, "value", "value", "value", "value").results) == 6


def test_joiners_and_sources(make, rows_of, spark, tmp_path):
    f = make([{}] * 4)
    side = spark.createDataFrame([(0, "x"), (1, "y")], "user long, name string")
    with pytest.raises(ValueError):
        StaticSpatialSource(side)
    source = StaticSpatialSource(side, ContextSchema(spatial_col="user"))
    got = rows_of(C.EnricherStep(source, C.SpatialJoin("zone", "user")).run(f))
    assert [r["name"] for r in got] == ["x", "y", "x", "y"]
    with pytest.raises(ValueError):
        C.TemporalJoin().join(f, source)
    timed = f.df.select("ts", "user", (F.col("id") * 10).alias("x"))
    both = StaticTemporalSource(timed, ContextSchema(timestamp_col="ts", spatial_col="user", attribute_cols=["x"]))
    got = rows_of(C.SpatioTemporalJoin(C.TemporalJoin("backward"), C.SpatialJoin("grid", "user")).join(f, both))
    assert [r["x"] for r in got] == [0, 10, 20, 30]
    path = str(tmp_path / "w")
    f.df.select(F.col("ts").alias("timestamp"), F.lit(50.0).alias("temperature_f")).write.parquet(path)
    weather = WeatherSource(path)
    assert weather.load().columns == ["timestamp", "temperature"] and weather.schema.timestamp_col == "timestamp"
    with pytest.raises(ValueError):
        DemographicsSource(path, "galaxy")


def test_tracking(tmp_path):
    from chronomesh.plans.tracking import JsonLinesTracker, MLflowTracker, TrackerProtocol

    t = JsonLinesTracker(tmp_path / "t.jsonl")
    assert isinstance(t, TrackerProtocol)
    t.log_param("a", 1)
    t.log_metric("m", 0.5, step=2)
    t.set_tags({"x": "y"})
    t.log_dict({"k": 1}, "f")
    t.log_artifact("p")
    found = [json.loads(x) for x in (tmp_path / "t.jsonl").read_text().splitlines()]
    assert [x["kind"] for x in found] == ["param", "metric", "tags", "dict", "artifact"] and found[1]["step"] == 2 and found[4]["artifact_path"] is None
    with pytest.raises(TypeError):
        t.log_param(key="a", nothing=1)
    with pytest.raises(ImportError):
        MLflowTracker("e")
