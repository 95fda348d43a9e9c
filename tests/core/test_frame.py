from datetime import timedelta

import pytest
from pydantic import ValidationError
from pyspark.sql import functions as F

from chronomesh.frame import EventFrame
from chronomesh.functions.time import parse_duration, parse_time_window
from chronomesh.pipeline import ConditionalStep, LambdaStep, ParallelSteps, Pipeline
from chronomesh.plans.recipes import BaseRecipe, get_recipe, list_datasets, list_recipes, register_recipe
from chronomesh.registry import FeatureStepRegistry, get_default_adapter_registry, get_default_registry
from chronomesh.schema import ContextSchema, EventSchema, Lineage, OutputModality


def test_schema_needs_a_place():
    with pytest.raises(ValidationError):
        EventSchema(timestamp_col="ts")
    assert EventSchema(timestamp_col="ts", geometry_col="g").geometry_col == "g"
    assert ContextSchema(interval_start_col="a", interval_end_col="b").has_temporal
    assert not ContextSchema(timestamp_col="a").has_spatial


def test_frame_is_immutable(make):
    f = make([{}] * 3)
    with pytest.raises(AttributeError):
        f.df = None
    g = f.with_columns(twice=F.col("value") * 2)
    assert "twice" not in f.df.columns and "twice" in g.df.columns
    assert f.filter(F.col("value") > 0, F.col("value") < 2).count() == 1
    assert [r["id"] for r in f.sort("ts", descending=True).df.collect()] == [2, 1, 0]
    assert len(f.head(2)) == 2 and len(f) == 3
    assert f.select("id").df.columns == ["id"]


def test_nulls_sort_first(make):
    f = make([{"value": 1.0}, {"value": None}, {"value": 0.5}])
    assert [r.id for r in f.sort("value").df.collect()] == [1, 2, 0]


def test_metadata_and_lineage(make):
    f = make([{}])
    g = f.register_feature("x", {"a": 1}, "sequence", Lineage(produced_by="me"))
    assert g.metadata.feature_catalog["x"] == {"a": 1}
    assert g.metadata.feature_provenance["x"].produced_by == "me"
    assert OutputModality.SEQUENCE in g.metadata.output_modalities
    with pytest.raises(ValueError):
        f.add_output_modality("smell")
    h = g.require_context(spatial_crs="EPSG:3857", context_tags=["w"]).require_context(spatial_crs="EPSG:4326")
    assert h.schema.context_requirements.spatial_crs == "EPSG:4326"
    assert h.schema.context_requirements.required_context == {"w"}


def test_pipeline_guards_the_schema(make):
    f = make([{}]).require_context(context_tags=["w"])
    p = Pipeline([LambdaStep(lambda x: x.with_columns(a=F.lit(1)))])
    assert "a" in p.run(f).df.columns and p.last_schema is not None and len(p) == 1
    forget = LambdaStep(lambda x: EventFrame(x.df, EventSchema(timestamp_col="ts", geometry_col="g"), make([{}]).metadata))
    with pytest.raises(ValueError):
        Pipeline([forget]).run(f)
    with pytest.raises(TypeError):
        Pipeline([LambdaStep(lambda x: x.df)]).run(f)
    one, two = LambdaStep(lambda x: x.with_columns(n=F.lit(1))), LambdaStep(lambda x: x.with_columns(n=F.lit(2)))
    assert ConditionalStep(lambda x: False, one, two).run(f).df.first()["n"] == 2
    assert ConditionalStep(lambda x: False, one).run(f) is f
    assert ParallelSteps([one, two]).run(f).df.first()["n"] == 2


def test_durations():
    assert parse_duration("6h") == 6 * 3600 * 10**6 and parse_duration("day") == parse_duration("1d") == parse_duration("24hr")
    for odd in ("", "x", "6", "1mo", "6 parsecs"):
        with pytest.raises(ValueError):
            parse_duration(odd)
    assert parse_time_window("7d") == {"days": 7}
    assert timedelta(**parse_time_window("2w")).days == 14


#: The names that a user of the library may rely on.
NAMES = """transform_crs assign_to_grid assign_to_zones compute_distances grid_aggregation kde spatial_lag local_moran getis_ord
extract_temporal_components time_bins temporal_lag moving_average recency_weight calendar_encoding inter_arrival
spatial_context_join temporal_context_join spatiotemporal_context_join context_aggregation
exponential_decay hawkes_kernel conditional_intensity pair_correlation k_function hazard_rate survival_table duration_features continuous_inter_event
streaming_window online_statistics streaming_hawkes event_buffer streaming_decay streaming_inter_event""".split()


def test_registries(make):
    r = get_default_registry()
    assert {s.name for s in r.list()} == set(NAMES)
    assert {s.name for s in r.list(tag="spatial")} >= {"kde", "transform_crs"}
    assert {s.name for s in get_default_adapter_registry().list()} == {"table", "sequence", "raster", "graph", "stream"}
    with pytest.raises(KeyError):
        r.get("nothing")
    own = FeatureStepRegistry()
    own.decorator("x", tags={"spatial"})(LambdaStep)
    with pytest.raises(ValueError):
        own.register("x", LambdaStep)
    with pytest.raises(ValueError):
        own.register("y", LambdaStep, tags={"smell"})
    p = r.build_pipeline([{"name": "time_bins", "params": {"bin_size": "6h"}}, "inter_arrival"])
    assert {"time_bin", "inter_arrival_seconds"} <= set(p.run(make([{}] * 2)).df.columns)


def test_recipes(make, tmp_path, capsys):
    assert "chicago_crime" in list_datasets() and "v1" in list_recipes("chicago_crime")
    with pytest.raises(ValueError):
        get_recipe("chicago_crime", "v9")

    class Mine(BaseRecipe):
        pass

    register_recipe("d", "mine", Mine)
    with pytest.raises(ValueError):
        register_recipe("d", "mine", Mine)
    out = Mine({"dataset": "d", "recipe": "mine", "features": {"steps": ["time_bins"]}}).run(make([{}]))
    assert "time_bin" in out.df.columns
    with pytest.raises(NotImplementedError):
        Mine({"dataset": "d", "recipe": "mine"}).run(make([{}]))
    found = get_recipe("chicago_crime", "v1")({"dataset": "chicago_crime", "recipe": "v1"}).run(make([{}] * 4))
    assert found.df.agg(F.sum("event_count")).first()[0] == 4 and found.df.where("grid_id is null").count() == 0

    from chronomesh.cli import main

    path = tmp_path / "c.yaml"
    path.write_text("dataset: chicago_crime\nrecipe: v1\n")
    assert main(["validate", str(path)]) == 0 and main(["list-steps"]) == 0 and "kde" in capsys.readouterr().out
    path.write_text("dataset: chicago_crime\nrecipe: v9\n")
    assert main(["validate", str(path)]) == 1


def test_crime_source_and_sink(spark, tmp_path):
    from chronomesh.cli import main
    from chronomesh.sources.crime import load_crime, sample

    rows = [("01/02/2024 03:04:05 PM", 41.8, -87.6, "true", "FALSE", "THEFT"), ("01/03/2024 12:00:00 AM", 91.0, -87.6, "true", "false", "THEFT"), ("bad", 41.9, None, "false", "true", "X"), ("01/05/2024 01:00:00 AM", 41.9, -87.7, "false", "true", "X")]
    raw = str(tmp_path / "raw" / "y=1")
    spark.createDataFrame(rows, "date string, latitude double, longitude double, arrest string, domestic string, primary_type string").write.parquet(raw)
    f = load_crime(str(tmp_path / "raw"))
    got = f.df.orderBy("date").collect()
    assert len(got) == 2 and got[0]["date"].hour == 15 and got[0]["arrest"] is True and got[0]["domestic"] is False
    assert sample(f, n=1).count() == 1
    with pytest.raises(ValueError):
        sample(f)
    config = tmp_path / "c.yaml"
    config.write_text("dataset: chicago_crime\nrecipe: v1\noutput: {partition_by: [year, month]}\n")
    assert main(["run", str(config), "--input", str(tmp_path / "raw"), "--output", str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "out")).select("year").distinct().count() == 1
