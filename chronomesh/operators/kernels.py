"""Plans that several operators share: sequences, scans, as-of joins, neighbours.

Sequences without groups would need one task for a global window. Here time is
cut into blocks; a block gets the few rows that it needs of the blocks before or
after it, or sums carried over from a table with one row a block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from chronomesh.frame import EventFrame
from chronomesh.functions.time import micros, parse_duration

BLOCK, HALO = "_block", "_halo"


def event_order(frame: EventFrame) -> list[str]:
    """Columns that order the events: the timestamp, then the id if there is one."""
    return [frame.schema.timestamp_col, *([frame.schema.id_col] if frame.schema.id_col else [])]


#: Estimated bytes of a plan from which its groups are counted, and rows of a group that one task should not sort.
CHECK_BYTES, HOT_ROWS = 8 << 30, 5_000_000


def spread_groups(df: DataFrame, keys: Sequence[str]) -> str:
    """The block of time by which groups are cut too, or nothing.

    A group of a large share of all rows then spreads over as many tasks as it has
    blocks, with the same results. The session's ``chronomesh.blockGroups``, such as
    ``1d`` or ``never``, decides. Without it the rows of the largest group do, which
    are counted where the optimizer takes the frame for large.
    """
    own = df.sparkSession.conf.get("chronomesh.blockGroups", "")
    if own or not keys:
        return "" if own == "never" else own
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < CHECK_BYTES:
        return ""
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    return "1d" if most > HOT_ROWS else ""


def sequenced(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str] = (), before: int = 0, after: int = 0, block: str = "1d"
) -> tuple[DataFrame, WindowSpec]:
    """A frame and a window in which each row sees ``before`` rows before and ``after`` rows after it.

    With keys the window is partitioned by them. Without, or if groups are spread
    (:func:`spread_groups`), by block of time too, and the frame has more rows: copies of ``order`` and ``cols`` of the neighbouring
    blocks' rows. Compute the columns, then call :func:`own_rows`.
    """
    spread = spread_groups(df, keys)
    if keys and not spread:
        return df, Window.partitionBy(*keys).orderBy(*order)
    width = parse_duration(spread or block)
    base = df.withColumns({BLOCK: F.floor(micros(order[0]) / width), HALO: F.lit(False)})
    dealt = [*keys, BLOCK]
    window = Window.partitionBy(*dealt).orderBy(*order)
    blocks = (Window.partitionBy(*keys) if keys else Window).orderBy(BLOCK)
    fields = [*order, *(c for c in dict.fromkeys(cols) if c not in (*order, *keys))]
    parts = [base]
    for n, ahead in ((before, False), (after, True)):
        if n <= 0:
            continue
        edge = Window.partitionBy(*dealt).orderBy(*((F.col(c).asc() if ahead else F.col(c).desc()) for c in order))
        rows = base.withColumn("_r", F.row_number().over(edge)).where(F.col("_r") <= n)
        ends = rows.groupBy(*dealt).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_rows"))  # n rows at most
        joined = F.flatten(F.collect_list("_rows").over(blocks.rowsBetween(1, n) if ahead else blocks.rowsBetween(-n, -1)))
        cut = F.slice("_rows", 1, n) if ahead else F.slice("_rows", -n, n)
        ends = ends.withColumn("_rows", joined).withColumn("_rows", F.when(F.size("_rows") <= n, F.col("_rows")).otherwise(cut))
        parts.append(ends.select(*dealt, F.explode("_rows").alias("_e")).select(*dealt, *(F.col("_e")[c].alias(c) for c in fields), F.lit(True).alias(HALO)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out, window


def own_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame's own rows again, with just these columns."""
    return (df.where(~F.col(HALO)) if HALO in df.columns else df).select(*(F.col(f"`{c}`") for c in columns))


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column], how: str = "sum", block: str = "1d", totals: bool = False
) -> DataFrame:
    """Running sums (``how`` may be min or max) up to and with each row, over keys or over all.

    Blocks are summed up, the sums of earlier blocks come from a window over one
    row a block and key. With ``totals`` there are also ``{name}_total`` columns.
    """
    fold = {"sum": F.sum, "min": F.min, "max": F.max}[how]
    merge = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}[how]
    base = df.withColumns({BLOCK: F.floor(micros(order[0]) / parse_duration(block)), **{f"_x_{k}": c for k, c in sums.items()}})
    per_block = base.groupBy(*keys, BLOCK).agg(*(fold(f"_x_{k}").alias(f"_s_{k}") for k in sums))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    earlier = over.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = per_block.select(
        *(F.col(k).alias(f"_k_{k}") for k in keys), F.col(BLOCK).alias("_b"),
        *(fold(f"_s_{k}").over(earlier).alias(f"_c_{k}") for k in sums),
        *(fold(f"_s_{k}").over(over).alias(f"_t_{k}") for k in sums if totals),
    )
    same = F.col(BLOCK).eqNullSafe(F.col("_b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    here = Window.partitionBy(*keys, BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = base.withColumns({f"_h_{k}": fold(f"_x_{k}").over(here) for k in sums}).join(carried, same, "left")
    made = {k: merge(F.col(f"_h_{k}"), F.col(f"_c_{k}")) for k in sums} | ({f"{k}_total": F.col(f"_t_{k}") for k in sums} if totals else {})
    return out.withColumns(made).select(*(c for c in df.columns if c not in made), *made)


def decayed_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], weight: Column, rate: float, out: str, position: Column | None = None, include_self: bool = True) -> DataFrame:
    """``out_i``: sum over rows j up to i of ``weight_j * exp(-rate * (x_i - x_j))``.

    x is the time in seconds, or ``position``. Blocks are 300 decay lengths long:
    within one the sum has a closed form as a running sum, and of the blocks
    before only the last one matters in double precision.
    """
    # whole units keep every digit: seconds since 1970 as a double are good to a quarter of a microsecond only
    x, units = (micros(order[0]), 1e6) if position is None else (position.cast("long"), 1.0)
    whole = max(1, int(300.0 / rate * units))
    width = whole / units
    base = df.withColumns({"_x": x, "_wt": weight.cast("double")}).withColumn("_rel", F.pmod("_x", F.lit(whole)) / F.lit(units))
    base = base.withColumn("_bl", ((F.col("_x") - F.pmod("_x", F.lit(whole))) / F.lit(whole)).cast("long"))
    grown = F.coalesce(F.col("_wt"), F.lit(0.0)) * F.exp(F.lit(rate) * F.col("_rel"))
    last = 0 if include_self else -1
    here = Window.partitionBy(*keys, "_bl").orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    tails = base.groupBy(*keys, "_bl").agg(F.sum(F.coalesce(F.col("_wt"), F.lit(0.0)) * F.exp(F.lit(rate) * (F.col("_rel") - F.lit(width)))).alias("_carry"))
    tails = tails.select(*(F.col(k).alias(f"_k_{k}") for k in keys), (F.col("_bl") + 1).alias("_b"), "_carry")
    same = F.col("_bl") == F.col("_b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    total = (F.coalesce(F.col("_loc"), F.lit(0.0)) + F.coalesce(F.col("_carry"), F.lit(0.0))) * F.exp(F.lit(-rate) * F.col("_rel"))
    joined = base.withColumn("_loc", F.sum(grown).over(here)).join(tails, same, "left")
    return joined.withColumn(out, total).select(*(c for c in df.columns if c != out), out)


def asof_join(
    left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, columns: Sequence[str], by: Sequence[tuple[str, str]] = (),
    direction: str = "backward", tolerance: str | None = None, keep_ts: str | None = None, block: str = "1d", ties: Sequence[str] = (),
) -> DataFrame:
    """``left`` plus the ``columns`` of the right row that is last at or before it (or next, or nearest).

    Of several right rows at the same time backward takes the last and forward the
    first, by the order of ``ties`` (columns of the right side) and then of their
    values; nearest prefers backward when both are equally far. Beyond ``tolerance`` the columns are null. ``keep_ts`` names a
    column for the right time. Both sides go through one window, keyed by ``by``;
    without keys by block of time, and the last row of earlier blocks is carried.
    """
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction: {direction}")
    limit = None if tolerance is None else parse_duration(tolerance)
    keys = [f"_k{i}" for i in range(len(by))]
    row = F.struct(F.col(right_ts).alias("_rts"), *(F.col(c).alias(c) for c in dict.fromkeys([*ties, *columns])))
    events = left.withColumns({"_us": micros(left_ts), **{k: F.col(a) for k, (a, _) in zip(keys, by)}, "_row": F.lit(None)})
    marks = right.where(F.col(right_ts).isNotNull()).select(micros(right_ts).alias("_us"), *(F.col(b).alias(k) for k, (_, b) in zip(keys, by)), row.alias("_row"))
    events = events.withColumn("_side", F.lit(1)).drop("_row")
    both = events.unionByName(marks.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    places, spread = keys, spread_groups(left, [a for a, _ in by])
    blocked = not by or bool(spread)
    if blocked:
        keys = [*keys, BLOCK]
        both = both.withColumn(BLOCK, F.floor(F.col("_us") / parse_duration(spread or block)))
    found = {}
    for way in ("backward", "forward") if direction == "nearest" else (direction,):
        back = way == "backward"
        # the forward search runs backward in time: a frame that grows from the start costs a row once
        first = [F.col("_us"), F.col("_side"), F.col("_row")] if back else [F.col("_us").desc(), F.col("_side"), F.col("_row").desc()]
        span = Window.partitionBy(*keys).orderBy(*first).rowsBetween(Window.unboundedPreceding, 0)
        both = both.withColumn(f"_{way}", F.last("_row", ignorenulls=True).over(span))
        if blocked:  # from the nearest block with marks: one row a block
            end = (F.max if back else F.min)(F.when(F.col("_side") == 0, F.struct("_us", "_row"))).alias("_end")
            blocks = both.groupBy(*keys).agg(end)
            far = (Window.partitionBy(*places) if places else Window).orderBy(F.col(BLOCK) if back else F.col(BLOCK).desc()).rowsBetween(Window.unboundedPreceding, -1)
            blocks = blocks.select(*(F.col(k).alias(f"_far{k}") for k in keys), F.last("_end", ignorenulls=True).over(far)["_row"].alias(f"_far_{way}"))
            same = F.lit(True)
            for k in keys:
                same = same & F.col(k).eqNullSafe(F.col(f"_far{k}"))
            both = both.join(blocks, same, "left").drop(*(f"_far{k}" for k in keys))
            found[way] = F.coalesce(F.col(f"_{way}"), F.col(f"_far_{way}"))
        else:
            found[way] = F.col(f"_{way}")
    gap = lambda c: F.abs(F.col("_us") - micros(c["_rts"]))
    if direction == "nearest":
        b, f = found["backward"], found["forward"]
        chosen = F.when(b.isNull() | (f.isNotNull() & (gap(f) < gap(b))), f).otherwise(b)
    else:
        chosen = found[direction]
    out = both.where("_side = 1").withColumn("_hit", chosen)
    if limit is not None:
        out = out.withColumn("_hit", F.when(gap(F.col("_hit")) <= limit, F.col("_hit")))
    made = {c: F.col("_hit")[c] for c in columns} | ({keep_ts: F.col("_hit")["_rts"]} if keep_ts else {})
    return out.withColumns(made).select(*(c for c in left.columns if c not in made), *made)


def neighbours(df: DataFrame, x: str, y: str, dx: float, dy: float, key: str, extra: Sequence[str] = ()) -> DataFrame:
    """Pairs of rows that lie in touching cells of dx by dy: an equi-join instead of all pairs.

    Columns: key, x, y, extras of the row, and the same with ``_n`` of the neighbour,
    the row itself included. Filter by the true distance afterwards.
    """
    cols = [key, x, y, *extra]
    cells = df.select(*cols).where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_cx": F.floor(F.col(x) / dx), "_cy": F.floor(F.col(y) / dy)})
    around = F.explode(F.array(*(F.struct((F.col("_cx") + i).alias("_cx"), (F.col("_cy") + j).alias("_cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    left = cells.select(*cols, around.alias("_c")).select(*cols, "_c.*")
    return left.join(cells.select(*(F.col(c).alias(f"{c}_n") for c in cols), "_cx", "_cy"), ["_cx", "_cy"]).drop("_cx", "_cy")
