"""Temporal, spatial and point-process steps against values worked out by hand or in plain Python."""

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from chronomesh.operators import features as FE
from chronomesh.operators import point_process as P
from chronomesh.operators import spatial as S
from chronomesh.operators import temporal as T
from tests.conftest import START

D = lambda **k: timedelta(**k)


def test_components_and_bins(make, rows_of):
    f = make([{"ts": datetime(2024, 1, 1, 5)}, {"ts": datetime(2024, 1, 6, 23, 59)}, {"ts": datetime(2024, 1, 7)}, {"ts": None}])
    got = rows_of(T.ExtractTemporalComponentsStep(["weekday", "is_weekend", "week", "hour"]).run(f))
    assert [r["weekday"] for r in got] == [1, 6, 7, None]
    assert [r["is_weekend"] for r in got] == [False, True, True, None]
    got = rows_of(T.create_temporal_windows(f, ["6h", "1w", "1mo"]))
    assert got[1]["window_6h"] == datetime(2024, 1, 6, 18) and got[1]["window_1w"] == datetime(2024, 1, 1) and got[2]["window_1mo"] == datetime(2024, 1, 1)
    with pytest.raises(ValueError):
        T.ExtractTemporalComponentsStep(["smell"]).run(f)
    g = T.TimeBinsStep("6h").run(f)
    assert g.metadata.time_bin == "6h" and g.schema.context_requirements.temporal_resolution == "6h"


def test_lags_and_averages_across_blocks(make, rows_of):
    # days with one row or none, so that neighbours lie several blocks away
    stamps = [START + D(days=d) for d in (0, 0, 1, 5, 6, 20)]
    f = make([{"ts": t, "value": float(10 * i)} for i, t in enumerate(stamps)])
    got = rows_of(T.TemporalLagStep(["value"], [1, 3, -2]).run(f))
    assert [r["value_lag_1"] for r in got] == [None, 0, 10, 20, 30, 40]
    assert [r["value_lag_3"] for r in got] == [None, None, None, 0, 10, 20]
    assert [r["value_lag_-2"] for r in got] == [20, 30, 40, 50, None, None]
    got = rows_of(T.MovingAverageStep(["value"], [2, 4]).run(f))
    assert [r["value_ma_2"] for r in got] == [0, 5, 15, 25, 35, 45]
    assert [r["value_ma_4"] for r in got] == [0, 5, 10, 15, 25, 35]
    got = rows_of(T.InterArrivalStep().run(f))
    assert [r["inter_arrival_seconds"] for r in got] == [None, 0, 86400, 4 * 86400, 86400, 14 * 86400]


def test_feature_functions(make, rows_of):
    f = make([{"value": v, "kind": k} for v, k in ((1.0, "a"), (3.0, "b"), (None, "a"), (0.0, None))])
    got = rows_of(FE.normalize_features(f, ["value"], "minmax"))
    assert [r["value_normalized"] for r in got] == [1 / 3, 1.0, None, 0.0]
    flat = rows_of(FE.normalize_features(make([{"value": 2.0}] * 2), ["value"]))
    assert [r["value_normalized"] for r in flat] == [None, None]
    got = rows_of(FE.encode_categorical(f, "kind"))
    assert [(r["kind_a"], r["kind_b"]) for r in got] == [(1, 0), (0, 1), (1, 0), (0, 0)]
    got = rows_of(FE.encode_categorical(f, "kind", "ordinal"))
    assert [r["kind_encoded"] for r in got] == [0, 1, 0, None]
    with pytest.raises(ValueError):
        FE.encode_categorical(f, "kind", "target")
    with pytest.raises(ValueError):
        FE.encode_categorical(f, "kind", max_categories=1)
    counts = {r["user"]: r for r in FE.aggregate_by_category(f, ["user"], "kind").df.collect()}
    assert counts[1]["count_b"] == 1 and counts[0]["count_b"] == 0 and counts[0]["count_a"] == 2
    none = FE.aggregate_by_category(make([{"kind": None}] * 2), ["user"], "kind").df.collect()
    assert {r["count_total"] for r in none} == {1}
    assert rows_of(FE.compute_ratios(f, "id", "value"))[3]["id_per_value"] == 3 / 1e-10


def test_recency_and_decay(make, rows_of):
    f = make([{"ts": START + D(days=d)} for d in (0, 7, 14)])
    got = rows_of(T.RecencyWeightStep().run(f))
    assert got[2]["recency_weight"] == 1 and abs(got[1]["recency_weight"] - 0.5) < 1e-6 and abs(got[0]["recency_weight"] - 0.25) < 1e-6
    got = rows_of(P.ExponentialDecayStep(0.1, "1d").run(f))
    assert [round(r["decay_weight"], 9) for r in got] == [round(math.exp(-1.4), 9), round(math.exp(-0.7), 9), 1]


def test_hawkes_and_intensity(make, rows_of):
    hours = [0, 1, 1.5, 30, 30.5, 200]
    f = make([{"ts": START + D(hours=h)} for h in hours])
    got = rows_of(P.HawkesKernelStep(max_history=2).run(f))
    for i, r in enumerate(got):
        want = sum(0.5 * math.exp(-(hours[i] - hours[j])) for j in range(max(0, i - 2), i))
        assert abs(r["hawkes_trigger"] - want) < 1e-12 and abs(r["hawkes_intensity"] - want - 0.1) < 1e-12
    with pytest.raises(ValueError):
        P.HawkesKernelStep(alpha=1.0)
    kernels = {"exponential": lambda g: math.exp(-g / 2), "hawkes": lambda g: 0.5 * math.exp(-g / 2), "power_law": lambda g: (1 + g / 2) ** -2}
    for method, k in kernels.items():
        got = rows_of(P.ConditionalIntensityStep(method, 2.0).run(f))
        assert abs(got[0]["conditional_intensity"] - 1 / (6 * 3600)) < 1e-12
        for i in range(1, 6):
            assert abs(got[i]["conditional_intensity"] - sum(k(hours[i] - hours[j]) for j in range(i))) < 1e-9
        assert max(r["intensity_normalized"] for r in got) == 1


def test_survival_and_hazard(make, rows_of):
    f = make([{"ts": START + D(hours=h)} for h in (0, 1, 1, 50, 51)])
    got = rows_of(P.HazardRateStep().run(f))
    want = [1 / 5 + sum(1 / (5 - j) for j in range(1, i + 1)) for i in range(5)]
    assert all(abs(r["cumulative_hazard"] - w) < 1e-12 for r, w in zip(got, want))
    assert got[2]["hazard_rate"] == 0 and abs(got[1]["hazard_rate"] - 1 / 4 / 3600) < 1e-12
    got = rows_of(P.SurvivalTableStep().run(f))
    assert [round(r["survival_probability"], 12) for r in got] == [0.8, 0.6, 0.4, 0.2, 0]
    assert all(r["survival_lower"] <= r["survival_probability"] <= r["survival_upper"] for r in got)


def test_projections(make):
    """Control values of the projections' origins and, for Web Mercator, its edge."""
    spark = make([{}]).df.sparkSession
    from chronomesh.functions.geo import project

    def at(lon, lat, crs):
        x, y = project(F.lit(float(lon)), F.lit(float(lat)), "EPSG:4326", crs)
        return spark.range(1).select(x, y).first()

    x, y = at(180, 85.0511287798066, "EPSG:3857")
    assert abs(x - 20037508.342789) < 1e-3 and abs(y - 20037508.342789) < 1e-3
    x, y = at(-87, 0, "EPSG:32616")
    assert abs(x - 500000) < 1e-6 and abs(y) < 1e-6
    x, y = at(-(88 + 1 / 3), 36 + 2 / 3, "EPSG:26971")
    assert abs(x - 300000) < 1e-6 and abs(y) < 1e-6
    x, y = at(-116.25, 32 + 1 / 6, "EPSG:26946")
    assert abs(x - 2000000) < 1e-6 and abs(y - 500000) < 1e-6
    # on the central meridian the scale is k0: a degree of the meridian at 45 N is 111131.8 m on WGS84
    (_, a), (_, b) = at(-87, 44.5, "EPSG:32616"), at(-87, 45.5, "EPSG:32616")
    assert abs((b - a) / 0.9996 - 111131.8) < 1
    with pytest.raises(ValueError):
        project(F.lit(0.0), F.lit(0.0), "EPSG:4326", "EPSG:9999")


def test_grid(make, rows_of):
    f = make([{"lat": 0.0, "lon": 0.0}, {"lat": 2.5, "lon": 1.0}, {"lat": None, "lon": 1.0}])
    got = rows_of(S.AssignToGridStep(1.0).run(f))
    assert [r["grid_id"] for r in got] == [0, 200001, None]
    cells = S.create_grid(f.df.sparkSession, (0.0, 0.0, 1.0, 1.0), 0.5).collect()
    assert len(cells) == 9 and cells[4]["geometry"].startswith("POLYGON ((0.5 0.5, 1.0 0.5")
    assert rows_of(S.assign_to_grid(f, (0.0, 0.0, 1.0, 3.0), 0.5))[1]["grid_id"] == 5 * 3 + 2
    with pytest.raises(ValueError):
        S.AssignToGridStep(0.0)


#: A square with a hole, a concave shape, two parts.
SHAPES = [(1, "POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 3 1, 3 3, 1 3, 1 1))"), (2, "POLYGON ((10 0, 14 0, 14 4, 12 1, 10 4, 10 0))"), (3, "MULTIPOLYGON (((20 0, 21 0, 21 1, 20 1, 20 0)), ((30 0, 31 0, 31 1, 30 1, 30 0)))")]


def test_zones(make, rows_of):
    points = {(0.5, 0.5): 1, (2, 2): None, (3.5, 2): 1, (12, 3): None, (10.5, 1): 2, (20.5, 0.5): 3, (30.5, 0.5): 3, (25, 0.5): None, (0, 2): None, (4, 4): None}
    f = make([{"lon": float(x), "lat": float(y)} for x, y in points] + [{"lon": None}])
    zones = f.df.sparkSession.createDataFrame(SHAPES, "zone_id int, geometry string")
    assert [r["zone_id"] for r in rows_of(S.AssignToZonesStep(zones).run(f))] == [*points.values(), None]
    from chronomesh.operators.context import SpatialContextJoinStep

    got = rows_of(SpatialContextJoinStep(zones.withColumnRenamed("zone_id", "z"), "geometry", ["z"], "intersects", fill_value=-1).run(f))
    assert [r["z"] for r in got][8:] == [1, 1, -1]
    got = rows_of(SpatialContextJoinStep(zones.withColumnRenamed("zone_id", "z"), "geometry", ["z"], "nearest").run(f))
    assert [r["z"] for r in got] == [1, 1, 1, 2, 2, 3, 3, 3, 1, 1, None]
    got = rows_of(SpatialContextJoinStep(zones.withColumnRenamed("zone_id", "z"), "geometry", ["z"], "nearest", max_distance=0.5).run(f))
    assert got[7]["z"] is None and got[0]["z"] == 1


def test_nearest_with_many_shapes(make, rows_of):
    """Beyond the few shapes that travel to every point the search widens in circles."""
    import random

    r = random.Random(3)
    shapes = [(k, r.uniform(0, 100), r.uniform(0, 100)) for k in range(300)]
    f = make([{"lon": r.uniform(-50, 150), "lat": r.uniform(0, 100)} for _ in range(40)])
    table = f.df.sparkSession.createDataFrame([(k, f"POINT ({x} {y})") for k, x, y in shapes], "z int, geometry string")
    from chronomesh.operators.context import SpatialContextJoinStep

    for row in rows_of(SpatialContextJoinStep(table, "geometry", ["z"], "nearest").run(f)):
        assert row["z"] == min(shapes, key=lambda s: math.hypot(s[1] - row["lon"], s[2] - row["lat"]))[0]


def _metres(a, b):
    h = math.sin(math.radians(b["lat"] - a["lat"]) / 2) ** 2 + math.cos(math.radians(a["lat"])) * math.cos(math.radians(b["lat"])) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_neighbour_counts(make, rows_of):
    import random

    r = random.Random(5)
    rows = [{"lon": r.uniform(-1, 1), "lat": r.uniform(59, 61)} for _ in range(60)] + [{"lon": 0.0, "lat": 60.0}] * 3
    f = make(rows)
    near = rows_of(P.PairCorrelationStep().run(f))
    k = rows_of(P.KFunctionStep(20000.0, transform="K").run(f))
    for i, a in enumerate(rows):
        gaps = [_metres(a, b) for j, b in enumerate(rows) if j != i]
        assert abs(near[i]["nearest_neighbor_distance"] - min(gaps)) < 1e-3
        assert k[i]["k_function_local"] == sum(g <= 20000 for g in gaps)
    assert rows_of(P.PairCorrelationStep().run(make([{}])))[0]["nearest_neighbor_distance"] == 0
    table = P.ripley_table(f, 50000.0, 10).orderBy("r").collect()
    assert [x["k"] for x in table] == sorted(x["k"] for x in table)


@pytest.mark.parametrize("kernel", ["box", "uniform", "gaussian", "epanechnikov"])
def test_kde(make, rows_of, kernel):
    xs = [0.0, 0.5, 0.9, 5.0]
    f = make([{"lon": x, "lat": 0.0} for x in xs])
    got = [r["kde_density"] for r in rows_of(S.KDEStep(1.0, kernel).run(f))]
    assert got[0] > got[3] > 0
    if kernel == "box":
        assert [round(g * math.pi) for g in got] == [3, 3, 3, 1]


def test_local_statistics(make, rows_of):
    f = make([{"value": v} for v in (1.0, 1.0, 1.0, 9.0, 9.0, 9.0)]).with_columns(grid_id=F.col("id"))
    got = rows_of(S.LocalMoranStep("value").run(f))
    assert got[0]["value_moran_cluster"] == "LL" and got[5]["value_moran_cluster"] == "HH"
    got = rows_of(S.GetisOrdStep("value").run(f))
    assert {r["value_hotspot"] for r in got} <= {"hot", "cold", "not_significant"}
    got = rows_of(S.SpatialLagStep(["value"]).run(f))
    assert [round(r["value_spatial_lag"], 6) for r in got] == [1, 1, round(11 / 3, 6), round(19 / 3, 6), 9, 9]


def test_empty_and_single(make):
    """Every ordered step on no event and on one."""
    from chronomesh.registry import get_default_registry

    plain = "time_bins inter_arrival hawkes_kernel conditional_intensity hazard_rate survival_table duration_features continuous_inter_event pair_correlation k_function kde streaming_window streaming_hawkes event_buffer streaming_inter_event recency_weight exponential_decay"
    for rows in ([], [{}]):
        f = make(rows)
        for name in plain.split():
            assert get_default_registry().create(name).run(f).count() == len(rows), name


def test_asof(make, rows_of):
    from chronomesh.operators.context import SpatioTemporalContextJoinStep, TemporalContextJoinStep

    f = make([{"ts": START + D(hours=h)} for h in (0, 24, 25, 100)])
    kind = ST.StructType([ST.StructField("t", ST.TimestampNTZType()), ST.StructField("x", ST.LongType()), ST.StructField("user", ST.LongType())])
    rows = [(START + D(hours=1), 1, 0), (START + D(hours=24), 2, 0), (START + D(hours=24), 3, 1), (START + D(hours=60), 4, 0)]
    ctx = f.df.sparkSession.createDataFrame(rows, kind)
    want = {"asof_backward": [None, 3, 3, 4], "asof_forward": [1, 2, 4, None], "nearest": [1, 3, 3, 4]}
    for strategy, xs in want.items():
        got = rows_of(TemporalContextJoinStep(ctx.drop("user"), "t", ["x"], strategy).run(f))
        assert [r["x"] for r in got] == xs, strategy
    got = rows_of(TemporalContextJoinStep(ctx.drop("user"), "t", ["x"], "asof_backward", "2h", -1).run(f))
    assert [r["x"] for r in got] == [-1, 3, 3, -1]
    got = rows_of(SpatioTemporalContextJoinStep(ctx.withColumnRenamed("t", "ts"), "user", "ts", ["x"]).run(f))
    assert [r["x"] for r in got] == [None, 3, 2, 3]


def test_neighbours_where_events_crowd(make, rows_of, monkeypatch):
    """All events but two in one cell: the search starts small and finds what brute force finds."""
    import math
    import random

    from chronomesh.operators import point_process as P

    monkeypatch.setattr(P, "CROWD", 3)
    r = random.Random(3)
    places = [(-87.6 + r.random() * 1e-4, 41.8 + r.random() * 1e-4) for _ in range(60)] + [(-88.0, 42.0), (-80.0, 30.0)]

    def metres(a, b):
        h = math.sin(math.radians(b[1] - a[1]) / 2) ** 2 + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))

    got = rows_of(P.PairCorrelationStep().run(make([{"lon": x, "lat": y} for x, y in places])))
    for i, row in enumerate(got):
        assert abs(row["nearest_neighbor_distance"] - min(metres(places[i], b) for j, b in enumerate(places) if j != i)) < 1e-3
