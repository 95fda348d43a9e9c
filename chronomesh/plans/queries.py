"""Queries over the driver's tables, each with its SQL.

``events`` has no coordinates; they are derived by the same arithmetic here and in
SQL. All statements read the view ``e`` that :data:`E` defines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronomesh.adapters.graph import GraphAdapter
from chronomesh.adapters.raster import RasterAdapter
from chronomesh.adapters.sequence import SequenceAdapter
from chronomesh.adapters.stream import StreamAdapter
from chronomesh.adapters.table import TableAdapter
from chronomesh.frame import EventFrame
from chronomesh.operators import context as C
from chronomesh.operators import features as FE
from chronomesh.operators import point_process as P
from chronomesh.operators import spatial as S
from chronomesh.operators import temporal as T
from chronomesh.pipeline import Pipeline
from chronomesh.schema import ContextSchema, EventMetadata, EventSchema
from chronomesh.sources.context import DynamicTemporalSource, StaticSpatialSource, StaticTemporalSource
from chronomesh.streaming import steps as R
from chronomesh.streaming.runner import sessionize, tumbling

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The events with coordinates, in SQL.
E = """e AS (SELECT event_id, ts, user_id, event_type, value,
  CAST(41.64 AS DOUBLE) + ((user_id * 37 + event_id * 11) % 380) * CAST(0.001 AS DOUBLE) + CAST(0.0005 AS DOUBLE) AS lat,
  CAST(-87.94 AS DOUBLE) + ((user_id * 53 + event_id * 7) % 420) * CAST(0.001 AS DOUBLE) + CAST(0.0005 AS DOUBLE) AS lon FROM events)"""
GRID = "CAST(floor((lat - CAST(41.64 AS DOUBLE)) / CAST(0.02 AS DOUBLE)) * 100000 + floor((lon - CAST(-87.94 AS DOUBLE)) / CAST(0.02 AS DOUBLE)) AS BIGINT)"
US = "epoch_us({})"


def events(spark: SparkSession, sf_dir: str) -> EventFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")

    def derived(start: float, a: int, b: int, n: int):
        return F.lit(start) + ((F.col("user_id") * a + F.col("event_id") * b) % n) * F.lit(0.001) + F.lit(0.0005)

    df = df.withColumns({"lat": derived(41.64, 37, 11, 380), "lon": derived(-87.94, 53, 7, 420)})
    schema = EventSchema(timestamp_col="ts", lat_col="lat", lon_col="lon", id_col="event_id", categorical_cols=["event_type"], numeric_cols=["value"])
    return EventFrame(df, schema, EventMetadata(dataset_name="events"))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            first = "WITH RECURSIVE" if "RECURSIVE_" in sql else "WITH"
            SQL[f.__name__] = f"{first} {E} {sql}" if not sql.lstrip().startswith(",") else f"{first} {E}{sql}"
        return f

    return wrap


def rounded(frame: EventFrame | DataFrame, *cols: str, keep: tuple[str, ...] = ("event_id",), digits: int = 6) -> DataFrame:
    """The key and the columns, floating ones rounded, names without dots, integers as long."""
    df = frame.df if isinstance(frame, EventFrame) else frame
    kinds = dict(df.dtypes)
    shown = []
    for c in cols:
        x = F.col(f"`{c}`")
        kind = kinds[c]
        x = F.floor(x * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits) if kind == "double" else x.cast("long") if kind in ("int", "bigint", "smallint", "tinyint") else x
        shown.append(x.alias(c.replace(".", "_")))
    return df.select(*keep, *shown)


def R6(x: str, digits: int = 6) -> str:
    """Rounded as :func:`rounded` does, by the same arithmetic."""
    return f"floor(CAST({x} AS DOUBLE) * CAST(1e{digits} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1e{digits} AS DOUBLE)"


GRID_STEP = S.AssignToGridStep(0.02, (-87.94, 41.64))


def _gridded(spark: SparkSession, sf_dir: str) -> EventFrame:
    return GRID_STEP.run(events(spark, sf_dir))


@query(f"SELECT {GRID} AS grid_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS time_bin, count(*) AS event_count FROM e GROUP BY 1, 2")
def flagship_grid_counts(spark, sf_dir):
    """Events by grid cell and six-hour bin."""
    return FE.aggregate_counts(Pipeline([T.TimeBinsStep("6h"), GRID_STEP]).run(events(spark, sf_dir)), ["grid_id", "time_bin"]).df


@query("""SELECT event_id, hour(ts) AS hour, isodow(ts) AS weekday, day(ts) AS day, dayofyear(ts) AS day_of_year, month(ts) AS month, year(ts) AS year,
 weekofyear(ts) AS week, quarter(ts) AS quarter, isodow(ts) >= 6 AS is_weekend FROM e""")
def temporal_components(spark, sf_dir):
    names = ["hour", "weekday", "day", "day_of_year", "month", "year", "week", "quarter", "is_weekend"]
    return rounded(T.ExtractTemporalComponentsStep(names).run(events(spark, sf_dir)), *names)


@query("""SELECT event_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS time_bin FROM e""")
def time_bins_6h(spark, sf_dir):
    return T.TimeBinsStep("6h").run(events(spark, sf_dir)).df.select("event_id", "time_bin")


@query("""SELECT event_id, date_trunc('hour', ts) AS window_1h, CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_1d, CAST(date_trunc('week', ts) AS TIMESTAMP) AS window_1w, CAST(date_trunc('month', ts) AS TIMESTAMP) AS window_1mo FROM e""")
def temporal_windows(spark, sf_dir):
    sizes = ["1h", "1d", "1w", "1mo"]
    return T.create_temporal_windows(events(spark, sf_dir), sizes).df.select("event_id", *(f"window_{w}" for w in sizes))


@query(f"SELECT event_id, {R6('exp(-(CAST(0.693147 AS DOUBLE) / (7 * 86400)) * date_sub(chr(115)||chr(101)||chr(99)||chr(111)||chr(110)||chr(100), ts, (SELECT max(ts) FROM e)))')} AS recency_weight FROM e".replace("date_sub(chr(115)||chr(101)||chr(99)||chr(111)||chr(110)||chr(100)", "date_sub('second'"))
def recency_weight(spark, sf_dir):
    return rounded(T.RecencyWeightStep().run(events(spark, sf_dir)), "recency_weight")


@query(", x AS (SELECT event_id, hour(ts) AS h, isodow(ts) AS d, day(ts) AS m, month(ts) AS mo, weekofyear(ts) AS w FROM e) SELECT event_id, "
       + ", ".join(f"{R6(f'{f}(2 * pi() * {c} / {p})')} AS {n}_{f}" for n, c, p in (("hour", "h", 24), ("dow", "d", 7), ("dom", "m", 31), ("month", "mo", 12), ("woy", "w", 53)) for f in ("sin", "cos")) + " FROM x")
def calendar_cyclical(spark, sf_dir):
    f = T.CalendarEncodingStep("cyclical", list(T.CALENDAR)).run(events(spark, sf_dir))
    return rounded(f, *(f"{n}_{k}" for n in ("hour", "dow", "dom", "month", "woy") for k in ("sin", "cos")))


@query("SELECT event_id, hour(ts) AS hour_ordinal, isodow(ts) AS dow_ordinal, day(ts) AS dom_ordinal, month(ts) AS month_ordinal, weekofyear(ts) AS woy_ordinal FROM e")
def calendar_ordinal(spark, sf_dir):
    f = T.CalendarEncodingStep("ordinal", list(T.CALENDAR)).run(events(spark, sf_dir))
    return rounded(f, *(f"{n}_ordinal" for n in ("hour", "dow", "dom", "month", "woy")))


@query("SELECT event_id, " + ", ".join(f"CAST(isodow(ts) = {d} AS BIGINT) AS dow_{d}" for d in range(1, 8)) + " FROM e")
def calendar_onehot(spark, sf_dir):
    return rounded(T.CalendarEncodingStep("onehot", ["day_of_week"]).run(events(spark, sf_dir)), *(f"dow_{d}" for d in range(1, 8)))


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS n_click, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'purchase') AS n_purchase, count(*) FILTER (event_type = 'signup') AS n_signup, count(*) FILTER (event_type = 'view') AS n_view FROM e GROUP BY user_id")
def counts_by_category(spark, sf_dir):
    return FE.aggregate_by_category(events(spark, sf_dir), ["user_id"], "event_type", "n").df


@query(f", g AS (SELECT *, {GRID} AS grid_id FROM e) SELECT event_id, grid_id, count(*) OVER w AS event_count, {R6('sum(value) OVER w')} AS value_sum, {R6('avg(value) OVER w')} AS value_mean, {R6('stddev_samp(value) OVER w')} AS value_std, min(value) OVER w + 0.0 AS value_min, max(value) OVER w + 0.0 AS value_max FROM g WINDOW w AS (PARTITION BY grid_id)")
def grid_aggregation(spark, sf_dir):
    f = S.GridAggregationStep("grid_id", ["count", "sum", "mean", "std", "min", "max"], ["value"]).run(_gridded(spark, sf_dir))
    return rounded(f, "grid_id", "event_count", "value_sum", "value_mean", "value_std", "value_min", "value_max")


@query("SELECT event_id, " + ", ".join(f"CAST(event_type = '{v}' AS BIGINT) AS event_type_{v}" for v in ("click", "error", "purchase", "signup", "view")) + " FROM e")
def onehot(spark, sf_dir):
    f = FE.encode_categorical(events(spark, sf_dir), "event_type")
    return rounded(f, *(f"event_type_{v}" for v in ("click", "error", "purchase", "signup", "view")))


@query("SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type_encoded FROM e")
def ordinal(spark, sf_dir):
    return rounded(FE.encode_categorical(events(spark, sf_dir), "event_type", "ordinal"), "event_type_encoded")


@query(f"SELECT event_id, {R6('(value - (SELECT avg(value) FROM e)) / (SELECT stddev_samp(value) FROM e)')} AS value_normalized FROM e")
def zscore(spark, sf_dir):
    return rounded(FE.normalize_features(events(spark, sf_dir), ["value"]), "value_normalized")


@query(f"SELECT event_id, {R6('(value - (SELECT min(value) FROM e)) / (SELECT max(value) - min(value) FROM e)')} AS value_normalized FROM e")
def minmax(spark, sf_dir):
    return rounded(FE.normalize_features(events(spark, sf_dir), ["value"], "minmax"), "value_normalized")


@query(f"SELECT event_id, {R6('value / greatest(CAST(user_id AS DOUBLE), 1e-10)')} AS value_per_user_id FROM e WHERE user_id > 0")
def ratio(spark, sf_dir):
    return rounded(FE.compute_ratios(events(spark, sf_dir).filter(F.col("user_id") > 0), "value", "user_id"), "value_per_user_id")


@query("SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 7) OVER w AS value_lag_7, lead(value, 2) OVER w AS \"value_lag_-2\" FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def temporal_lag(spark, sf_dir):
    return T.TemporalLagStep(["value"], [1, 7, -2], group_cols=["user_id"]).run(events(spark, sf_dir)).df.select("event_id", "value_lag_1", "value_lag_7", "`value_lag_-2`")


@query("SELECT event_id, lag(value, 1) OVER w AS value_lag_1, lag(value, 3) OVER w AS value_lag_3, lead(value, 1) OVER w AS \"value_lag_-1\" FROM e WINDOW w AS (ORDER BY ts, event_id)")
def lag_all(spark, sf_dir):
    """Lags over all events, without groups."""
    return FE.lag_features(events(spark, sf_dir), "value", [1, 3, -1]).df.select("event_id", "value_lag_1", "value_lag_3", "`value_lag_-1`")


@query(f"SELECT event_id, {R6('avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 6 PRECEDING)')} AS value_ma_7, {R6('avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)')} AS value_ma_3 FROM e")
def moving_average(spark, sf_dir):
    return rounded(T.MovingAverageStep(["value"], [7, 3], group_cols=["user_id"]).run(events(spark, sf_dir)), "value_ma_7", "value_ma_3")


@query(f"SELECT event_id, {R6('avg(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)')} AS value_ma_7 FROM e")
def moving_average_centred(spark, sf_dir):
    return rounded(T.MovingAverageStep(["value"], [7], center=True).run(events(spark, sf_dir)), "value_ma_7")


@query(f", u AS (SELECT *, epoch_us(ts) AS us FROM e) SELECT event_id, {R6('sum(value) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 604799999999 PRECEDING AND CURRENT ROW)')} AS value_sum_7d FROM u")
def moving_window_7d(spark, sf_dir):
    return rounded(FE.moving_window_aggregation(events(spark, sf_dir), "7d", ["user_id"], "value", "sum"), "value_sum_7d")


@query(f", x AS (SELECT *, date_sub('second', lag(ts) OVER (ORDER BY ts, event_id), ts) AS g FROM e) SELECT event_id, g AS inter_arrival_seconds, {R6('avg(g) OVER (ORDER BY ts, event_id ROWS 9 PRECEDING)')} AS inter_arrival_seconds_ma_10, {R6('stddev_samp(g) OVER (ORDER BY ts, event_id ROWS 9 PRECEDING)')} AS inter_arrival_seconds_std_10 FROM x")
def inter_arrival(spark, sf_dir):
    f = T.InterArrivalStep(include_stats=True, stat_windows=[10]).run(events(spark, sf_dir))
    return rounded(f, "inter_arrival_seconds", "inter_arrival_seconds_ma_10", "inter_arrival_seconds_std_10")


@query(f", x AS (SELECT event_id, date_sub('second', lag(ts) OVER w, ts) AS l, date_sub('second', ts, lead(ts) OVER w) AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), y AS (SELECT *, CAST(coalesce(l, 0) AS DOUBLE) AS x FROM x) SELECT event_id, l AS time_since_last, n AS time_to_next, {R6('exp(-0.1 * x / 3600)')} AS time_since_last_exp_0_1, {R6('1 / pow(1 + x / 3600, 0.5)')} AS time_since_last_pow_0_5, {R6('greatest(0, least(1, 1 - x / 86400))')} AS time_since_last_linear, {R6('1 / (1 + ln(x / 3600 + 1))')} AS time_since_last_log FROM y")
def duration_features(spark, sf_dir):
    f = P.DurationFeaturesStep(["exponential", "power_law", "linear", "logarithmic"], [0.1], [0.5], group_cols=["user_id"]).run(events(spark, sf_dir))
    return rounded(f, "time_since_last", "time_to_next", "time_since_last_exp_0.1", "time_since_last_pow_0.5", "time_since_last_linear", "time_since_last_log")


@query(f", x AS (SELECT event_id, ts, date_sub('second', lag(ts) OVER (ORDER BY ts, event_id), ts) AS g FROM e), y AS (SELECT *, avg(g) OVER w AS m, stddev_samp(g) OVER w AS s FROM x WINDOW w AS (ORDER BY ts, event_id ROWS 4 PRECEDING)) SELECT event_id, g AS inter_event_seconds, {R6('ln(coalesce(g, 1) + 1)')} AS inter_event_log, {R6('g / (SELECT avg(g) FROM x)')} AS inter_event_normalized, {R6('m')} AS inter_event_mean_5, {R6('s')} AS inter_event_std_5, {R6('s / coalesce(m, 1)')} AS inter_event_cv_5 FROM y")
def continuous_inter_event(spark, sf_dir):
    f = P.ContinuousInterEventStep(rolling_windows=[5]).run(events(spark, sf_dir))
    return rounded(f, "inter_event_seconds", "inter_event_log", "inter_event_normalized", "inter_event_mean_5", "inter_event_std_5", "inter_event_cv_5")


@query(f"SELECT event_id, {R6('exp(-(CAST(0.1 AS DOUBLE) / 3600) * date_sub(chr(0), ts, max(ts) OVER (PARTITION BY user_id)))')} AS decay_weight FROM e".replace("chr(0)", "'second'"))
def exponential_decay(spark, sf_dir):
    return rounded(P.ExponentialDecayStep(group_cols=["user_id"]).run(events(spark, sf_dir)), "decay_weight")


def later_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The side table of the temporal joins: all events, an hour later."""
    o = spark.read.parquet(f"{sf_dir}/events.parquet")
    return o.select((F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("cts"), F.col("user_id").alias("cuser"), F.col("event_id").alias("cid"), F.col("value").alias("cvalue"))


CTX = "c AS (SELECT ts + INTERVAL 1 HOUR AS cts, user_id AS cuser, event_id AS cid, value AS cvalue FROM events)"


def _asof(spark, sf_dir, strategy: str, tolerance: str | None = None) -> DataFrame:
    step = C.TemporalContextJoinStep(later_events(spark, sf_dir), "cts", ["cid", "cvalue"], strategy, tolerance)
    return step.run(events(spark, sf_dir)).df.select("event_id", "cid", "cvalue")


@query(f", {CTX} SELECT event_id, cid, cvalue FROM e ASOF LEFT JOIN c ON e.ts >= c.cts")
def asof_backward(spark, sf_dir):
    return _asof(spark, sf_dir, "asof_backward")


@query(f", {CTX} SELECT event_id, cid, cvalue FROM e ASOF LEFT JOIN c ON e.ts <= c.cts")
def asof_forward(spark, sf_dir):
    return _asof(spark, sf_dir, "asof_forward")


@query(f", {CTX}, b AS (SELECT event_id, ts, cid, cvalue, cts FROM e ASOF LEFT JOIN c ON e.ts >= c.cts), f AS (SELECT event_id, cid, cvalue, cts FROM e ASOF LEFT JOIN c ON e.ts <= c.cts) SELECT event_id, CASE WHEN k THEN b.cid ELSE f.cid END AS cid, CASE WHEN k THEN b.cvalue ELSE f.cvalue END AS cvalue FROM (SELECT b.*, f.cid AS fcid, f.cts IS NULL OR (b.cts IS NOT NULL AND epoch_us(ts) - epoch_us(b.cts) <= epoch_us(f.cts) - epoch_us(ts)) AS k FROM b JOIN f USING (event_id)) b JOIN f USING (event_id)")
def asof_nearest(spark, sf_dir):
    return _asof(spark, sf_dir, "nearest")


@query(f", {CTX} SELECT event_id, CASE WHEN e.ts - c.cts <= INTERVAL 10 MINUTE THEN cid END AS cid, CASE WHEN e.ts - c.cts <= INTERVAL 10 MINUTE THEN cvalue END AS cvalue FROM e ASOF LEFT JOIN c ON e.ts >= c.cts")
def asof_tolerance(spark, sf_dir):
    return _asof(spark, sf_dir, "asof_backward", "10m")


@query(f", {CTX} SELECT event_id, cid, cvalue FROM e ASOF LEFT JOIN c ON e.user_id = c.cuser AND e.ts >= c.cts")
def asof_by_key(spark, sf_dir):
    context = later_events(spark, sf_dir).withColumnsRenamed({"cuser": "user_id", "cts": "ts"})
    step = C.SpatioTemporalContextJoinStep(context, "user_id", "ts", ["cid", "cvalue"])
    return step.run(events(spark, sf_dir)).df.select("event_id", "cid", "cvalue")


@query("SELECT a.event_id, b.event_id AS cid FROM e a LEFT JOIN (SELECT event_id, CASE WHEN event_type = 'click' THEN ts ELSE ts + INTERVAL 1 HOUR END AS ts FROM events) b ON a.ts = b.ts")
def temporal_exact(spark, sf_dir):
    """A side table of all events, those that are no clicks an hour later."""
    when = F.when(F.col("event_type") == "click", F.col("ts")).otherwise(F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    context = spark.read.parquet(f"{sf_dir}/events.parquet").select(when.alias("cts"), F.col("event_id").alias("cid"))
    return T.align_temporal(events(spark, sf_dir), context, "cts", "exact").df.select("event_id", "cid")


@query(f", {CTX}, b AS (SELECT event_id, ts, cts FROM e ASOF LEFT JOIN c ON e.ts >= c.cts), f AS (SELECT event_id, cts AS fts FROM e ASOF LEFT JOIN c ON e.ts <= c.cts) SELECT event_id, date_sub('second', CASE WHEN fts IS NULL OR epoch_us(ts) - epoch_us(cts) <= epoch_us(fts) - epoch_us(ts) THEN cts ELSE fts END, ts) AS time_delta FROM b JOIN f USING (event_id)")
def time_deltas(spark, sf_dir):
    return T.compute_time_deltas(events(spark, sf_dir), later_events(spark, sf_dir), "cts").df.select("event_id", "time_delta")


@query(f", x AS (SELECT user_id + 3 AS user_id, avg(value) AS a, max(value) AS b, count(value) AS n FROM events GROUP BY 1) SELECT event_id, {R6('a')} AS ctx_value_mean, b + 0.0 AS ctx_value_max, n AS ctx_value_count FROM e LEFT JOIN x USING (user_id)")
def context_aggregation(spark, sf_dir):
    """Aggregates of another user's events; the first three users have none."""
    side = spark.read.parquet(f"{sf_dir}/events.parquet").select((F.col("user_id") + 3).alias("user_id"), "value")
    f = C.ContextAggregationStep(side, ["user_id"], {"value": ["mean", "max", "count"]}, ["user_id"]).run(events(spark, sf_dir))
    return rounded(f, "ctx_value_mean", "ctx_value_max", "ctx_value_count")


@query(", c AS (SELECT event_id AS cid, ts AS a, ts + INTERVAL 10 MINUTE AS z FROM events) SELECT event_id, cid FROM e LEFT JOIN c ON e.ts >= a AND e.ts < z")
def interval_join(spark, sf_dir):
    """Events in the ten minutes after each event."""
    side = spark.read.parquet(f"{sf_dir}/events.parquet")
    side = side.select(F.col("event_id").alias("cid"), F.col("ts").alias("a"), (F.col("ts") + F.expr("INTERVAL 10 MINUTE")).alias("z"))
    source = StaticTemporalSource(side, ContextSchema(interval_start_col="a", interval_end_col="z", attribute_cols=["cid"]))
    return C.EnricherStep(source, C.IntervalJoin()).run(events(spark, sf_dir)).df.select("event_id", "cid")


@query(f", {CTX} SELECT event_id, cid FROM e ASOF LEFT JOIN c ON e.ts >= c.cts")
def enricher_temporal(spark, sf_dir):
    source = DynamicTemporalSource(later_events(spark, sf_dir), ContextSchema(timestamp_col="cts", attribute_cols=["cid"]))
    return C.EnricherStep(source, C.TemporalJoin("backward")).run(events(spark, sf_dir)).df.select("event_id", "cid")


@query(f", r AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts, event_id) AS rn FROM e), t AS (SELECT a.event_id, sum(0.5 * 1.0 * exp((b.us - a.us) * (CAST(1.0 AS DOUBLE) / 3600) / 1e6)) AS s FROM r a JOIN r b ON b.rn < a.rn AND b.rn >= a.rn - 100 GROUP BY 1) SELECT event_id, {R6('coalesce(s, 0)')} AS hawkes_trigger, {R6('coalesce(s, 0) + 0.1')} AS hawkes_intensity, 0.1 + CAST(0 AS DOUBLE) AS hawkes_background FROM e LEFT JOIN t USING (event_id)")
def hawkes_kernel(spark, sf_dir):
    return rounded(P.HawkesKernelStep().run(events(spark, sf_dir)), "hawkes_trigger", "hawkes_intensity", "hawkes_background")


@query(f", r AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts, event_id) AS rn FROM e), t AS (SELECT a.event_id, sum(exp((b.us - a.us) / 3.6e9)) AS s FROM r a JOIN r b ON b.rn < a.rn AND b.us > a.us - 50 * 3600000000 GROUP BY 1), v AS (SELECT event_id, CASE WHEN rn = 1 THEN 1.0 / ((SELECT count(*) FROM e) * 3600.0) ELSE coalesce(s, 0) END AS c FROM r LEFT JOIN t USING (event_id)) SELECT event_id, {R6('c')} AS conditional_intensity, {R6('c / (SELECT max(c) FROM v)')} AS intensity_normalized FROM v")
def conditional_intensity(spark, sf_dir):
    return rounded(P.ConditionalIntensityStep().run(events(spark, sf_dir)), "conditional_intensity", "intensity_normalized")


@query(f", r AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (ORDER BY ts, event_id) AS rn FROM e), t AS (SELECT a.event_id, sum(pow(1 + (a.us - b.us) / 3.6e9, -2)) AS s FROM r a JOIN r b ON b.rn < a.rn GROUP BY 1), v AS (SELECT event_id, CASE WHEN rn = 1 THEN 1.0 / ((SELECT count(*) FROM e) * 3600.0) ELSE coalesce(s, 0) END AS c FROM r LEFT JOIN t USING (event_id)) SELECT event_id, {R6('c')} AS conditional_intensity, {R6('c / (SELECT max(c) FROM v)')} AS intensity_normalized FROM v")
def conditional_intensity_power_law(spark, sf_dir):
    return rounded(P.ConditionalIntensityStep("power_law").run(events(spark, sf_dir)), "conditional_intensity", "intensity_normalized")


@query(f", r AS (SELECT event_id, epoch_us(ts) AS us, row_number() OVER w - 1 AS i, (SELECT count(*) FROM e) AS n, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS g FROM e WINDOW w AS (ORDER BY ts, event_id)) SELECT event_id, {R6('CASE WHEN i = 0 THEN 1.0 / n WHEN g > 0 THEN (1.0 / (n - i)) / greatest(g, 1) ELSE 0 END')} AS hazard_rate, {R6('sum(1.0 / (n - i)) OVER (ORDER BY i)')} AS cumulative_hazard FROM r")
def hazard_rate(spark, sf_dir):
    return rounded(P.HazardRateStep().run(events(spark, sf_dir)), "hazard_rate", "cumulative_hazard")


@query(f", r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM e), s AS (SELECT event_id, (n - i - 1) / CAST(n AS DOUBLE) AS s, CASE WHEN n - i - 1 > 0 THEN (n - i - 1) / CAST(n AS DOUBLE) * sqrt(1.0 / (n - i - 1) - 1.0 / n) ELSE 0 END AS err FROM r) SELECT event_id, {R6('s')} AS survival_probability, {R6('greatest(0, s - 1.96 * err)')} AS survival_lower, {R6('least(1, s + 1.96 * err)')} AS survival_upper FROM s")
def survival_table(spark, sf_dir):
    return rounded(P.SurvivalTableStep(group_cols=["user_id"]).run(events(spark, sf_dir)), "survival_probability", "survival_lower", "survival_upper")


@query(f"SELECT event_id, {R6('sqrt(pow(lon - CAST(-87.63 AS DOUBLE), 2) + pow(lat - CAST(41.88 AS DOUBLE), 2))')} AS dist_to_loop, {R6('sqrt(pow(lon - CAST(-87.9 AS DOUBLE), 2) + pow(lat - CAST(41.98 AS DOUBLE), 2))')} AS dist_to_airport FROM e")
def distances(spark, sf_dir):
    pois = spark.createDataFrame([("loop", -87.63, 41.88), ("airport", -87.9, 41.98)], "name string, longitude double, latitude double")
    return rounded(S.ComputeDistancesStep(pois).run(events(spark, sf_dir)), "dist_to_loop", "dist_to_airport")


#: Half-open quarters and a triangle with a hole, none with events on a side.
ZONES = [(1, "POLYGON ((-87.94 41.64, -87.7401 41.64, -87.7401 41.8401, -87.94 41.8401, -87.94 41.64))"), (2, "POLYGON ((-87.7401 41.64, -87.52 41.64, -87.52 41.8401, -87.7401 41.8401, -87.7401 41.64), (-87.6501 41.7001, -87.6001 41.7001, -87.6001 41.7501, -87.6501 41.7501, -87.6501 41.7001))"), (3, "MULTIPOLYGON (((-87.94 41.8401, -87.9001 41.8401, -87.9001 41.9001, -87.94 41.9001, -87.94 41.8401)), ((-87.6001 41.9001, -87.52 41.9001, -87.52 42.02, -87.6001 42.02, -87.6001 41.9001)))")]


@query("SELECT event_id, CASE WHEN lon BETWEEN -87.94 AND -87.7401 AND lat BETWEEN 41.64 AND 41.8401 THEN 1 WHEN lon BETWEEN -87.7401 AND -87.52 AND lat BETWEEN 41.64 AND 41.8401 AND NOT (lon BETWEEN -87.6501 AND -87.6001 AND lat BETWEEN 41.7001 AND 41.7501) THEN 2 WHEN (lon <= -87.9001 AND lat BETWEEN 41.8401 AND 41.9001) OR (lon >= -87.6001 AND lat >= 41.9001) THEN 3 END::BIGINT AS zone_id FROM e")
def zones(spark, sf_dir):
    table = spark.createDataFrame(ZONES, "zone_id int, geometry string")
    return rounded(S.AssignToZonesStep(table).run(events(spark, sf_dir)), "zone_id")


@query("SELECT event_id, CASE WHEN lon BETWEEN -87.94 AND -87.7401 AND lat BETWEEN 41.64 AND 41.8401 THEN 'west' ELSE 'other' END AS zname FROM e")
def spatial_context(spark, sf_dir):
    table = spark.createDataFrame([("west", ZONES[0][1])], "zname string, geometry string")
    return C.SpatialContextJoinStep(table, "geometry", ["zname"], "intersects", fill_value="other").run(events(spark, sf_dir)).df.select("event_id", "zname")


@query(", p AS (SELECT * FROM (VALUES ('a', -87.63, 41.88), ('b', -87.9, 41.98), ('c', -87.75, 41.7)) AS t(pname, x, y)) SELECT event_id, min_by(pname, (round(d, 9), pname)) AS pname FROM (SELECT event_id, pname, sqrt(pow(lon - x, 2) + pow(lat - y, 2)) AS d FROM e CROSS JOIN p) GROUP BY 1")
def spatial_nearest(spark, sf_dir):
    table = spark.createDataFrame([("a", "POINT (-87.63 41.88)"), ("b", "POINT (-87.9 41.98)"), ("c", "POINT (-87.75 41.7)")], "pname string, geometry string")
    return C.SpatialContextJoinStep(table, "geometry", ["pname"], "nearest").run(events(spark, sf_dir)).df.select("event_id", "pname")


@query(f", t AS (SELECT event_id, lon, lat FROM e ), k AS (SELECT a.event_id, count(*) AS n FROM t a JOIN t b ON abs(a.lon - b.lon) <= 0.01 AND abs(a.lat - b.lat) <= 0.01 GROUP BY 1) SELECT event_id, {R6('n * CAST(1.0 AS DOUBLE) / (pi() * 0.01 * 0.01)', 4)} AS kde_density FROM k")
def kde_box(spark, sf_dir):
    f = events(spark, sf_dir)
    return rounded(S.KDEStep(0.01).run(f), "kde_density", digits=4)


HAV = "2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h))"
PAIRS = "t AS (SELECT event_id, lon, lat FROM e), p AS (SELECT a.event_id, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h FROM t a JOIN t b ON a.event_id <> b.event_id)"


@query(f", {PAIRS}, k AS (SELECT event_id, count(*) FILTER ({HAV} <= 1500.5) AS k FROM p GROUP BY 1) SELECT event_id, {R6('sqrt(k / pi())')} AS l_function_local FROM k")
def k_function(spark, sf_dir):
    return rounded(P.KFunctionStep(1500.5).run(events(spark, sf_dir)), "l_function_local")


@query(f", {PAIRS} SELECT event_id, {R6(f"min({HAV})", 3)} AS nearest_neighbor_distance FROM p GROUP BY 1")
def nearest_neighbor(spark, sf_dir):
    return rounded(P.PairCorrelationStep().run(events(spark, sf_dir)), "nearest_neighbor_distance", digits=3)


CELLS = f"g AS (SELECT *, {GRID} AS grid_id FROM e)"


@query(f", {CELLS}, c AS (SELECT grid_id, avg(value) AS m FROM g GROUP BY 1) SELECT event_id, {R6('avg(m) OVER (ORDER BY grid_id, ts, event_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)')} AS value_spatial_lag FROM g JOIN c USING (grid_id)")
def spatial_lag(spark, sf_dir):
    return rounded(S.SpatialLagStep(["value"]).run(_gridded(spark, sf_dir)), "value_spatial_lag")


#: Cells with exact means, and the mean over the cells around, added up from the least: the same in any order of the rows.
EXACT = "c AS (SELECT grid_id, CAST(sum(CAST(value AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS m FROM g GROUP BY 1)"
NEAR = "n AS (SELECT c.grid_id, list_sum(list_sort(list(d.m))) / count(*) AS v FROM c JOIN c d ON d.grid_id <> c.grid_id AND {} GROUP BY 1)"
QUEEN = "abs(d.grid_id // 100000 - c.grid_id // 100000) <= 1 AND abs(d.grid_id % 100000 - c.grid_id % 100000) <= 1"
ROOK = "abs(d.grid_id // 100000 - c.grid_id // 100000) + abs(d.grid_id % 100000 - c.grid_id % 100000) <= 1"
DISTANCE = "pow(d.grid_id // 100000 - c.grid_id // 100000, 2) + pow(d.grid_id % 100000 - c.grid_id % 100000, 2) <= 6.25"


def exact_cells(spark: SparkSession, sf_dir: str) -> EventFrame:
    """Events by cell with decimal values."""
    return _gridded(spark, sf_dir).with_columns(value=F.col("value").cast("decimal(18,6)"))


@query(f", {CELLS}, {EXACT}, {NEAR.format(QUEEN)} SELECT event_id, {R6('v')} AS value_spatial_lag FROM g LEFT JOIN n USING (grid_id)")
def spatial_lag_queen(spark, sf_dir):
    return rounded(S.SpatialLagStep(["value"], mode="queen").run(exact_cells(spark, sf_dir)), "value_spatial_lag")


@query(f", {CELLS}, c AS (SELECT grid_id, avg(value) AS m FROM g GROUP BY 1), z AS (SELECT grid_id, (m - (SELECT avg(m) FROM c)) / (SELECT stddev_samp(m) FROM c) AS z FROM c), l AS (SELECT *, avg(z) OVER (ORDER BY grid_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS l FROM z) SELECT event_id, {R6('z * l')} AS value_local_moran_i, CASE WHEN z > 0 AND l > 0 THEN 'HH' WHEN z < 0 AND l < 0 THEN 'LL' WHEN z > 0 AND l < 0 THEN 'HL' WHEN z < 0 AND l > 0 THEN 'LH' ELSE 'NS' END AS value_moran_cluster FROM g JOIN l USING (grid_id)")
def local_moran(spark, sf_dir):
    return rounded(S.LocalMoranStep("value").run(_gridded(spark, sf_dir)), "value_local_moran_i", "value_moran_cluster")


@query(f", {CELLS}, c AS (SELECT grid_id, sum(value) AS m FROM g GROUP BY 1), l AS (SELECT grid_id, (sum(m) OVER (ORDER BY grid_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) - 3 * (SELECT avg(m) FROM c)) / (SELECT stddev_samp(m) FROM c) AS z FROM c) SELECT event_id, {R6('z')} AS value_gi_star, CASE WHEN z > 1.96 THEN 'hot' WHEN z < -1.96 THEN 'cold' ELSE 'not_significant' END AS value_hotspot FROM g JOIN l USING (grid_id)")
def getis_ord(spark, sf_dir):
    return rounded(S.GetisOrdStep("value").run(_gridded(spark, sf_dir)), "value_gi_star", "value_hotspot")


@query(f"SELECT event_id, {R6('radians(lon) * 6378137.0', 3)} AS lon_proj, {R6('ln(tan(pi() / 4 + radians(lat) / 2)) * 6378137.0', 3)} AS lat_proj FROM e")
def crs_webmercator(spark, sf_dir):
    return rounded(S.TransformCRSStep("EPSG:3857").run(events(spark, sf_dir)), "lon_proj", "lat_proj", digits=3)


@query("SELECT r * 5 + c AS grid_id, CAST(-1 + c * 0.5 AS DOUBLE) AS minx, CAST(2 + r * 0.5 AS DOUBLE) AS miny, CAST(-1 + c * 0.5 + 0.5 AS DOUBLE) AS maxx, CAST(2 + r * 0.5 + 0.5 AS DOUBLE) AS maxy FROM (SELECT unnest(range(3)) AS r), (SELECT unnest(range(5)) AS c)".replace("unnest(range(3)) AS r), (SELECT unnest(range(5)) AS c)", "unnest(range(3)) AS r) AS a CROSS JOIN (SELECT unnest(range(5)) AS c) AS b"))
def grid_cells(spark, sf_dir):
    return rounded(S.create_grid(spark, (-1.0, 2.0, 1.0, 3.0), 0.5), "grid_id", "minx", "miny", "maxx", "maxy", keep=())


@query(", r AS (SELECT *, epoch_us(ts) AS us, row_number() OVER w AS rn FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, greatest(min(rn) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 21600000000 PRECEDING AND CURRENT ROW), rn - 4, 1) AS st FROM r) SELECT s.event_id, s.rn - s.st + 1 AS stream_window_size, (s.us - b.us) / 1e6 AS stream_window_duration, s.st - coalesce(lag(s.st) OVER (PARTITION BY s.user_id ORDER BY s.rn), 1) AS stream_events_expired FROM s JOIN r b ON b.user_id = s.user_id AND b.rn = s.st")
def streaming_window(spark, sf_dir):
    return rounded(R.StreamingWindowStep(5, "6h", group_cols=["user_id"]).run(events(spark, sf_dir)), "stream_window_size", "stream_window_duration", "stream_events_expired")


@query(f"SELECT event_id, {R6('avg(value) OVER w')} AS value_online_mean, {R6('coalesce(stddev_samp(value) OVER w, 0)')} AS value_online_std, min(value) OVER w + 0.0 AS value_online_min, max(value) OVER w + 0.0 AS value_online_max FROM e WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def online_statistics(spark, sf_dir):
    return rounded(R.OnlineStatisticsStep(["value"]).run(events(spark, sf_dir)), "value_online_mean", "value_online_std", "value_online_min", "value_online_max")


@query(f", r AS (SELECT *, epoch_us(ts) AS us FROM e), t AS (SELECT a.event_id, sum(0.5 * exp((b.us - a.us) / 3.6e9)) AS s FROM r a JOIN r b ON (b.us < a.us OR (b.us = a.us AND b.event_id <= a.event_id)) AND b.us > a.us - 50 * 3600000000 GROUP BY 1) SELECT event_id, {R6('s + 0.1')} AS streaming_hawkes_intensity, {R6('s')} AS streaming_hawkes_trigger FROM t")
def streaming_hawkes(spark, sf_dir):
    return rounded(R.StreamingHawkesStep().run(events(spark, sf_dir)), "streaming_hawkes_intensity", "streaming_hawkes_trigger")


@query(f", r AS (SELECT *, epoch_us(ts) AS us FROM e), t AS (SELECT a.event_id, sum(b.value * exp(CAST(0.1 AS DOUBLE) * (b.us - a.us) / 3.6e9)) AS s FROM r a JOIN r b ON a.user_id = b.user_id AND (b.us < a.us OR (b.us = a.us AND b.event_id <= a.event_id)) GROUP BY 1) SELECT event_id, {R6('s')} AS value_decayed_sum FROM t")
def streaming_decay(spark, sf_dir):
    return rounded(R.StreamingDecayStep(["value"], group_cols=["user_id"]).run(events(spark, sf_dir)), "value_decayed_sum")


@query(f", r AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS rn FROM e) SELECT event_id, rn % 1000 AS buffer_position, {R6('(rn % 1000) / 1000.0')} AS buffer_fill_ratio, rn // 1000 AS buffer_flush_count FROM r")
def event_buffer(spark, sf_dir):
    return rounded(R.EventBufferStep().run(events(spark, sf_dir)), "buffer_position", "buffer_fill_ratio", "buffer_flush_count")


@query(f", r AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER w AS rn, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6, 0) AS g, min(epoch_us(ts)) OVER (PARTITION BY user_id) AS t0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), t AS (SELECT a.event_id, sum(CASE WHEN b.rn = 1 THEN 0 WHEN b.rn = 2 THEN 1 ELSE 0.1 END * b.g * pow(CAST(0.9 AS DOUBLE), a.rn - b.rn)) AS s FROM r a JOIN r b ON a.user_id = b.user_id AND b.rn <= a.rn GROUP BY 1) SELECT event_id, g + 0.0 AS streaming_inter_event, {R6('s')} AS streaming_inter_event_ema, {R6('CASE WHEN us > t0 THEN rn / ((us - t0) / 1e6 / 3600.0) ELSE 0 END')} AS streaming_event_rate FROM r JOIN t USING (event_id)")
def streaming_inter_event(spark, sf_dir):
    return rounded(R.StreamingInterEventStep(group_cols=["user_id"]).run(events(spark, sf_dir)), "streaming_inter_event", "streaming_inter_event_ema", "streaming_event_rate")


BY_CELL = f"g AS (SELECT *, {GRID} AS grid_id, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS day FROM e)"


@query("SELECT event_id, 1.0::FLOAT AS _intercept, value::FLOAT AS value, user_id::FLOAT AS user_id, event_type FROM e")
def table_features(spark, sf_dir):
    return TableAdapter(index_cols=["event_id"], feature_cols=["value", "user_id"], target_col="event_type", include_intercept=True).frame(events(spark, sf_dir))


@query(f", {CELLS}, r AS (SELECT grid_id AS unit, row_number() OVER (PARTITION BY grid_id ORDER BY ts, event_id) - 1 AS position, count(*) OVER (PARTITION BY grid_id) AS length, value FROM g) SELECT * FROM r")
def sequence_long(spark, sf_dir):
    long = SequenceAdapter(feature_cols=["value"]).frame(_gridded(spark, sf_dir))
    return rounded(long, "unit", "position", "length", "value", keep=())


@query(f", {BY_CELL}, t AS (SELECT day, dense_rank() OVER (ORDER BY day) - 1 AS t FROM g GROUP BY day), c AS (SELECT grid_id, row_number() OVER (ORDER BY grid_id) - 1 AS i FROM g GROUP BY grid_id), n AS (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) AS w FROM c) SELECT t, i // w AS \"row\", i % w AS col, day AS time, arg_max(value, (day, event_id)) AS value FROM g JOIN t USING (day) JOIN c USING (grid_id) CROSS JOIN n GROUP BY 1, 2, 3, 4")
def raster_long(spark, sf_dir):
    f = T.TimeBinsStep("1d", "day").run(_gridded(spark, sf_dir))
    long = RasterAdapter(timestamp_col="day", grid_col="grid_id", feature_cols=["value"]).frame(f)
    return rounded(long, "t", "row", "col", "time", "value", keep=())


@query(f", {CELLS}, m AS (SELECT grid_id AS node, avg(value) AS v FROM g GROUP BY 1) SELECT node, row_number() OVER (ORDER BY node) - 1 AS n, {R6('v')} AS value FROM m")
def graph_nodes(spark, sf_dir):
    return rounded(GraphAdapter(feature_cols=["value"]).nodes(_gridded(spark, sf_dir)), "node", "n", "value", keep=())


@query(f", {CELLS}, m AS (SELECT grid_id AS node, avg(lon) AS x, avg(lat) AS y FROM g GROUP BY 1), p AS (SELECT a.node AS src, b.node AS dst, 1 / (sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) + 1e-6) AS w FROM m a JOIN m b ON a.node <> b.node AND sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 0.025), d AS (SELECT src AS v, sum(w) AS d FROM p GROUP BY 1) SELECT src, dst, {R6('w')} AS weight, {R6('w / sqrt(a.d * b.d)')} AS norm FROM p JOIN d a ON a.v = src JOIN d b ON b.v = dst")
def graph_edges(spark, sf_dir):
    return rounded(GraphAdapter(spatial_threshold=0.025).edges(_gridded(spark, sf_dir)), "src", "dst", "weight", "norm", keep=())


@query(f", {BY_CELL}, m AS (SELECT day, grid_id AS node, avg(value) AS v FROM g GROUP BY 1, 2) SELECT day AS snapshot, node, {R6('coalesce(v, 0)')} AS value FROM m")
def graph_snapshots(spark, sf_dir):
    return rounded(GraphAdapter(feature_cols=["value"], snapshot_interval="1d").snapshots(_gridded(spark, sf_dir)), "snapshot", "node", "value", keep=())


@query(f", r AS (SELECT event_id, floor(epoch_us(ts) / 1e6) AS s, value, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type, row_number() OVER (ORDER BY ts, event_id) AS rn FROM e), t AS (SELECT *, s - (SELECT min(s) FROM r) AS time FROM r) SELECT event_id, time + 0.0 AS time, event_type, coalesce(time - lag(time) OVER (ORDER BY rn), 0) + 0.0 AS inter_time, value FROM t")
def stream_long(spark, sf_dir):
    long = StreamAdapter(state_cols=["value"], event_type_col="event_type").frame(events(spark, sf_dir))
    return rounded(long, "time", "event_type", "inter_time", "value")


@query(", x AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts)), y AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM x) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM y GROUP BY user_id, k")
def sessions(spark, sf_dir):
    out = sessionize(events(spark, sf_dir).df, "ts", "30 minutes", ["user_id"])
    return out.select("user_id", *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")), "n")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n FROM e GROUP BY 1, 2, 3")
def tumbling_counts(spark, sf_dir):
    out = tumbling(events(spark, sf_dir).df, "ts", "1 hour", ["event_type"])
    return out.select(*(F.col(c).cast("timestamp_ntz").alias(c) for c in ("window_start", "window_end")), "event_type", "n")


@query(f"SELECT event_id, lat, lon, value FROM e WHERE lat BETWEEN 41.7 AND 41.9 AND value > 100")
def filtered(spark, sf_dir):
    """Projection and filters of a frame."""
    f = events(spark, sf_dir).filter(F.col("lat").between(41.7, 41.9), F.col("value") > 100).select("event_id", "lat", "lon", "value")
    return rounded(f, "lat", "lon", "value", digits=9)


@query(f", p AS (SELECT event_id, user_id, value, {GRID} AS grid_id FROM e) SELECT event_id, x.value AS xvalue FROM p LEFT JOIN (SELECT grid_id, max(value) AS value FROM p GROUP BY 1) AS x USING (grid_id)")
def enricher_spatial(spark, sf_dir):
    """A side table by grid cell."""
    f = _gridded(spark, sf_dir)
    source = StaticSpatialSource(f.df.groupBy("grid_id").agg(F.max("value").alias("xvalue")), ContextSchema(spatial_col="grid_id"))
    return C.EnricherStep(source, C.SpatialJoin("grid", "grid_id")).run(f).df.select("event_id", "xvalue")


def _all() -> None:
    from chronomesh.plans import queries_more  # noqa: F401


def queries() -> dict[str, Query]:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)
