"""Streaming steps: closed forms, state machines and real streams give the same columns."""

import math
from datetime import timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronomesh.pipeline import Pipeline
from chronomesh.streaming import steps as R
from chronomesh.streaming.runner import BranchingPipeline, StreamPipeline, sessionize, tumbling
from chronomesh.streaming.state import StreamEvent, StreamState, batch_stream_iterator
from chronomesh.operators.temporal import TimeBinsStep
from tests.conftest import START

STEPS = [
    lambda g: R.StreamingWindowStep(3, "5h", group_cols=g), lambda g: R.StreamingWindowStep(4, group_cols=g),
    lambda g: R.OnlineStatisticsStep(["value"], group_cols=g), lambda g: R.StreamingHawkesStep(group_cols=g),
    lambda g: R.EventBufferStep(3, group_cols=g), lambda g: R.EventBufferStep(3, "4h", group_cols=g), lambda g: R.EventBufferStep(5, flush_on_full=False, group_cols=g),
    lambda g: R.StreamingDecayStep(["value"], group_cols=g), lambda g: R.StreamingInterEventStep(0.3, group_cols=g),
]


def simulated(step, rows, keys):
    """The state machine in plain Python."""
    states, out = {}, {}
    for i, r in sorted(enumerate(rows), key=lambda x: (x[1]["ts"], x[0])):
        key = tuple(r[k] for k in keys)
        states.setdefault(key, step.initialize_state())
        out[i] = step.process_event(StreamEvent(r["ts"], r, 0), states[key])
    return out


def close(a, b):
    return a == b or (a is not None and b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))


events = st.lists(st.tuples(st.integers(0, 400_000), st.one_of(st.none(), st.floats(-5, 5)), st.integers(0, 1)), min_size=1, max_size=40)


@pytest.mark.parametrize("k", range(len(STEPS)))
@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(drawn=events)
def test_closed_form_is_the_state_machine(make, rows_of, k, drawn):
    # ties in time are broken by id; values may be null
    rows = [{"ts": START + timedelta(seconds=s - s % 7), "value": v, "user": u} for s, v, u in drawn]
    for keys in ([], ["user"]):
        step = STEPS[k](keys)
        want = simulated(step, rows, keys)
        for r in rows_of(step.run(make(rows))):
            assert all(close(r[c], want[r["id"]].get(c)) for c in step.outputs()), (keys, r, want[r["id"]])


def test_decay_of_statistics(make, rows_of):
    step = R.OnlineStatisticsStep(["value"], ["mean"], 0.5, decay=True)
    got = [r["value_online_mean"] for r in rows_of(step.run(make([{"value": 1.0}, {"value": 3.0}])))]
    assert got[0] == 1 and abs(got[1] - 1 - 2 / 1.5) < 1e-12


def test_partition_count_does_not_matter(make, rows_of, spark):
    f = make([{"ts": START + timedelta(hours=7 * i % 50)} for i in range(30)])
    pipe = Pipeline([s([]) for s in (STEPS[0], STEPS[3], STEPS[8])])
    want = rows_of(pipe.run(f))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert rows_of(pipe.run(f)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_micro_batches_keep_state(make, rows_of):
    f = make([{}] * 10)
    pipe = StreamPipeline([R.EventBufferStep(4), R.StreamingWindowStep(6)])
    parts = list(pipe.run_incremental(f, 4))
    assert [p.count() for p in parts] == [4, 4, 2]
    got = sorted((r.id, r.buffer_flush_count, r.stream_window_size) for p in parts for r in p.df.collect())
    assert got == [(r["id"], r["buffer_flush_count"], r["stream_window_size"]) for r in rows_of(pipe.run(f))]
    pipe.reset_state()
    assert pipe.process_event({"ts": START}, "ts")["buffer_position"] == 1
    assert [len(b) for b in batch_stream_iterator(f, 3)] == [3, 3, 3, 1]
    s = StreamState(1, keep_history=True)
    s.update(2)
    assert (s.value, s.history) == (2, [1])


def test_branching(make):
    pipe = BranchingPipeline.from_steps([TimeBinsStep("6h"), R.EventBufferStep(4)])
    assert len(pipe.batch) == 1 and len(pipe.streams.steps) == 1
    assert {"time_bin", "buffer_position"} <= set(pipe.run(make([{}] * 3)).df.columns)


def test_stream_equals_batch(make, rows_of, spark, tmp_path):
    f = make([{"ts": START + timedelta(minutes=20 * i), "user": i % 3} for i in range(30)])
    src = str(tmp_path / "src")
    for i in range(3):  # three files, one a micro-batch
        f.df.where(F.floor(F.col("id") / 10) == i).coalesce(1).write.mode("append").parquet(src)
        import time

        time.sleep(1.1)
    steps = [s(["user"]) for s in (STEPS[0], STEPS[3], STEPS[8])]
    stream = spark.readStream.schema(f.df.schema).option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    out = StreamPipeline(steps).stream(stream, "ts", ["user"], id_col="id")
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = rows_of(Pipeline(steps).run(f))
    assert len(got) == 30
    for r in want:
        for s in steps:
            assert all(close(r[c], got[r["id"]][c]) for c in s.outputs()), r["id"]


def test_windows_of_time(make):
    f = make([{"ts": START + timedelta(minutes=m), "user": 1} for m in (0, 10, 50, 70)])
    assert sorted(r.n for r in sessionize(f.df, "ts", "30 minutes", ["user"]).collect()) == [2, 2]
    assert sorted(r.n for r in tumbling(f.df, "ts", "1 hour").collect()) == [1, 3]
    assert sum(r.n for r in tumbling(f.df, "ts", "1 hour", slide="30 minutes").collect()) == 8


@pytest.mark.parametrize("by_count", [False, True])
def test_spread_groups_change_nothing(make, rows_of, spark, monkeypatch, by_count):
    """Groups cut by blocks of time, for hot ones, give what whole groups give; by the setting or by their counts."""
    from chronomesh.operators import features as FE
    from chronomesh.operators import kernels
    from chronomesh.pipeline import LambdaStep
    from pyspark.sql import types as ST

    from chronomesh.operators import point_process as P
    from chronomesh.operators import temporal as T
    from chronomesh.operators.context import SpatioTemporalContextJoinStep

    f = make([{"ts": START + timedelta(hours=11 * i + i % 3), "user": [0, 0, None, 1][i % 4]} for i in range(40)])
    ctx = f.df.where("id % 9 = 0").select("user", F.col("ts"), (F.col("id") * 1).alias("x"))
    assert isinstance(ctx.schema["ts"].dataType, ST.TimestampNTZType)
    steps = [
        T.TemporalLagStep(["value"], [1, 4, -2], group_cols=["user"]), T.MovingAverageStep(["value"], [5], group_cols=["user"], center=True),
        P.HawkesKernelStep(max_history=4, group_cols=["user"]), P.DurationFeaturesStep(group_cols=["user"]), R.StreamingWindowStep(5, "40h", group_cols=["user"]),
        R.StreamingInterEventStep(group_cols=["user"]), LambdaStep(lambda x: FE.moving_window_aggregation(x, "30h", ["user"], "value", "sum")),
        *(SpatioTemporalContextJoinStep(ctx, "user", "ts", ["x"], way) for way in ("asof_backward", "asof_forward")),
    ]
    want = [rows_of(s.run(f)) for s in steps]
    if by_count:
        monkeypatch.setattr(kernels, "CHECK_BYTES", 0)
        monkeypatch.setattr(kernels, "HOT_ROWS", 5)
        assert kernels.spread_groups(f.df, ["user"]) == "1d" and kernels.spread_groups(f.df, ["id"]) == ""
    else:
        spark.conf.set("chronomesh.blockGroups", "1d")
    try:
        for s, w in zip(steps, want):
            got = rows_of(s.run(f))
            assert all(a.keys() == b.keys() and all(close(a[k], b[k]) if isinstance(a[k], float) else a[k] == b[k] for k in a) for a, b in zip(got, w)), s
    finally:
        spark.conf.unset("chronomesh.blockGroups")


def test_helpers():
    from pyspark.sql import types as ST

    from chronomesh.functions import util

    assert util.is_numeric(ST.LongType()) and util.is_categorical(ST.BooleanType()) and util.is_temporal(ST.TimestampNTZType())
    assert util.ProgressTracker(4).update(2) == 0.5
    with pytest.raises(ValueError):
        util.get_timezone("Nowhere/Land")
