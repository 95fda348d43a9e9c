"""Steps whose work must not grow faster than their input or output."""

from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import types as T

from chronomesh.adapters import base
from chronomesh.adapters.sequence import SequenceAdapter
from chronomesh.adapters.stream import StreamAdapter
from chronomesh.operators import context as C
from chronomesh.operators import features as FE
from chronomesh.plans.queries import queries
from chronomesh.schema import ContextSchema
from chronomesh.sources.context import StaticTemporalSource
from tests.conftest import START

SF = "/root/testdata/sf0.001"


def test_interval_blocks_are_as_long_as_the_intervals(spark, make):
    """An event meets the intervals around it, not those of its whole day; long and empty ones and ties count too."""
    rng = np.random.default_rng(3)
    at, start = rng.integers(0, 86_400, 400), rng.integers(0, 86_400, 300)
    length = np.where(np.arange(300) % 50 == 0, 40_000, rng.integers(0, 600, 300))
    frame = make([{"ts": START + timedelta(seconds=int(s)), "id": k} for k, s in enumerate(at)])
    rows = [(k, START + timedelta(seconds=int(a)), START + timedelta(seconds=int(a + n))) for k, (a, n) in enumerate(zip(start, length))]
    side = spark.createDataFrame(rows, "cid long, a timestamp_ntz, z timestamp_ntz")
    source = StaticTemporalSource(side, ContextSchema(interval_start_col="a", interval_end_col="z", attribute_cols=["cid"]))
    df = C.IntervalJoin().join(frame, source).df
    want = []
    for k, t in enumerate(at):
        hits = np.nonzero((start <= t) & (t < start + length))[0].tolist()
        want += [(k, c) for c in hits] or [(k, None)]
    key = lambda x: (x[0], -1 if x[1] is None else x[1])
    assert sorted(((r.id, r.cid) for r in df.collect()), key=key) == sorted(want, key=key)
    real = length[length > 0]
    width = -(-int(real.sum()) * 1_000_000 // len(real))
    assert str(width) in df._jdf.queryExecution().optimizedPlan().toString()
    own = C.IntervalJoin("1d").join(frame, source).df
    assert own.exceptAll(df).count() == 0 == df.exceptAll(own).count()


WANT = {"sum": sum, "min": min, "max": max, "count": len, "mean": np.mean, "std": lambda v: np.std(v, ddof=1) if len(v) > 1 else None}


@pytest.mark.parametrize("keys", [[], ["user"]])
@pytest.mark.parametrize("agg", sorted(WANT))
def test_moving_windows_are_two_running_aggregates(make, rows_of, keys, agg):
    """No frame slides over the rows of a window; ties, nulls, empty windows and rows just a window apart."""
    rng = np.random.default_rng(4)
    at = rng.integers(-40, 200, 300).tolist()
    value = [None if k % 7 == 0 else float(v) for k, v in enumerate(rng.normal(1e6, 1.0, 300))]
    frame = make([{"ts": START + timedelta(minutes=m), "id": k, "value": value[k]} for k, m in enumerate(at)])
    out = FE.moving_window_aggregation(frame, "20m", keys, "value", agg)
    plan = out.df._jdf.queryExecution().analyzed().toString()
    assert "unboundedpreceding" in plan and "RangeFrame, -" not in plan
    for r in rows_of(out):
        k = r["id"]
        held = [value[j] for j in range(300) if at[k] - 20 < at[j] <= at[k] and value[j] is not None and (not keys or j % 2 == k % 2)]
        want = WANT[agg](held) if held or agg == "count" else None
        got = r[f"value_{agg}_20m"]
        assert (got is None) == (want is None) and (want is None or abs(got - want) <= 1e-9 * max(1.0, abs(want)))
    assert dict(out.df.dtypes)[f"value_{agg}_20m"] == ("bigint" if agg == "count" else "double")


def test_moving_windows_keep_types_and_rows_without_a_time(make, rows_of):
    frame = make([{"ts": None if k < 3 else START + timedelta(hours=k), "id": k, "n": k, "word": "xyz"[k % 3]} for k in range(8)], n=T.LongType(), word=T.StringType())
    got = rows_of(FE.moving_window_aggregation(FE.moving_window_aggregation(frame, "2h", [], "n", "sum"), "2h", [], "word", "max"))
    assert [r["n_sum_2h"] for r in got] == [3, 3, 3, 3, 7, 9, 11, 13] and [r["word_max_2h"] for r in got] == ["z", "z", "z", "x", "y", "z", "z", "y"]


@pytest.mark.parametrize(("name", "same"), [("align_before", "asof_backward"), ("align_after", "asof_forward"), ("align_nearest", "asof_nearest")])
def test_rows_at_one_time_go_by_their_id(spark, tmp_path, name, same):
    """Of side rows at one time before takes the last id and after the first, whatever their users; so do the other as-of joins."""
    rows = [(k, START + timedelta(minutes=20 * (k // 4)), (k * 7) % 11, "view", float(k)) for k in range(60)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.cid for r in queries()[name](spark, str(tmp_path)).collect()}
    other = {r.event_id: r.cid for r in queries()[same](spark, str(tmp_path)).collect()}
    for k, r in enumerate(rows):
        lag = k // 4 - 3  # the side rows at the very time of the event, an hour later than they were
        if lag >= 0:
            assert got[k] == (4 * lag if name == "align_after" else 4 * lag + 3)
            assert got[k] == other[k]


@pytest.fixture
def no_gather(monkeypatch):
    """Nothing of the size of the events may come to the driver."""

    def refuse(self, df):
        raise AssertionError("gathered on the driver")

    monkeypatch.setattr(base.BaseModalityAdapter, "gather", refuse)


@pytest.mark.parametrize("fmt", base.PARTS)
def test_parts_keep_rows_and_types(spark, tmp_path, fmt):
    rows = [(k, None if k % 5 == 0 else k / 3, float("nan") if k == 7 else 1e300, "\u00e9\n" * (k % 2) or None, [[k * 0.1, 2.0], []], [True, False], k % 3, None if k == 3 else START + timedelta(microseconds=k)) for k in range(25)]
    df = spark.createDataFrame(rows, "id long, x double, y double, word string, v array<array<double>>, mask array<boolean>, n int, ts timestamp_ntz").repartition(3)
    df = df.withColumns({"at": df.ts.cast("timestamp"), "day": df.ts.cast("date")})
    base.write_parts(df, f"{tmp_path}/parts", fmt)
    back = base.read_parts(spark, f"{tmp_path}/parts", df.schema, fmt)
    assert back.dtypes == df.dtypes
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    base.write_parts(df.where("id < 0"), f"{tmp_path}/none", fmt)
    assert base.read_parts(spark, f"{tmp_path}/none", df.schema, fmt).collect() == []
    with pytest.raises(ValueError):
        base.write_parts(df, f"{tmp_path}/pickle", "pickle")


def test_stream_json_in_parts(spark, no_gather):
    """Places are those of the whole order, and the parts hold what the arrays do."""
    got = sorted(queries()["stream_json"](spark, SF).collect())
    assert [r.place for r in got] == list(range(len(got))) and len(got) == 1000
    assert all(a.time <= b.time for a, b in zip(got, got[1:]))


def test_placed_is_the_order_of_the_arrays(make, rows_of):
    frame = make([{"ts": None if k == 2 else START + timedelta(hours=(k * 29) % 40, days=k % 3), "id": k, "kind": None if k == 4 else "AB"[k % 2]} for k in range(30)])
    adapter = StreamAdapter(state_cols=["value"], event_type_col="kind", dtype="float64")
    whole = adapter.convert(frame)
    placed = sorted(adapter.placed(frame).collect(), key=lambda r: r.place)
    assert [r.place for r in placed] == list(range(29))
    assert [(r.time, r.value) for r in placed] == list(zip(whole.timestamps.tolist(), whole.states[:, 0].tolist()))
    for k, (times, states) in whole.get_sequences_by_type().items():
        mine = adapter.by_type(frame).where(f"event_type = {k}").orderBy("ts", "id").collect()
        assert [(r.time, r.value) for r in mine] == list(zip(times.tolist(), states[:, 0].tolist()))


def test_stream_by_type_stays_off_the_driver(spark, no_gather):
    got = {r.event_type: r.n for r in queries()["stream_by_type"](spark, SF).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4] and sum(got.values()) == 1000


@pytest.mark.parametrize("side", ["right", "left"])
def test_pieces_hold_the_sequences(make, side):
    """Uneven units in rows of four steps and of the longest sequence: the arrays' values, in order, with padding at the end asked for."""
    frame = make([{"ts": START + timedelta(hours=(k * 7) % 20), "id": k, "grid_id": None if k == 5 else int(k > 13)} for k in range(20)], grid_id=T.LongType())
    adapter = SequenceAdapter(feature_cols=["value"], dtype="float64", padding_value=-1.0, padding_side=side)
    whole = adapter.convert(frame)
    for size, shown in ((4, 4), (1000, 13)):
        rows = sorted(adapter.pieces(frame, size).collect(), key=lambda r: (r.unit, r.start))
        assert all(len(r["values"]) == len(r["mask"]) == shown for r in rows)
        for u in (0, 1):
            mine = [v[0] for r in rows if r.unit == u for v, m in zip(r["values"], r["mask"]) if m]
            assert mine == whole.sequences[u][whole.masks[u]][:, 0].tolist() and {r.length for r in rows if r.unit == u} == {len(mine)}
        assert all(v[0] == -1.0 for r in rows for v, m in zip(r["values"], r["mask"]) if not m)
        assert all(r["mask"] == sorted(r["mask"], reverse=side == "right") for r in rows)


@pytest.mark.parametrize("name", ["sequence_arrow", "table_parquet", "table_plain"])
def test_files_in_parts_stay_off_the_driver(spark, no_gather, name):
    assert queries()[name](spark, SF).count() == 1000
