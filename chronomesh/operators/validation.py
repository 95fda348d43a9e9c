"""Checks of point-process and survival features; each is one aggregate over the data."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronomesh.frame import EventFrame
from chronomesh.functions.time import micros
from chronomesh.operators.kernels import event_order, own_rows, sequenced
from chronomesh.plans.stage import staged


@dataclass
class ValidationResult:
    is_valid: bool
    check_name: str
    message: str
    details: dict[str, Any] = field(default_factory=dict)
    severity: str = "error"


@dataclass
class ValidationReport:
    """Valid if no check of severity error has failed."""

    results: list[ValidationResult] = field(default_factory=list)

    def _failed(self, severity: str) -> list[ValidationResult]:
        return [r for r in self.results if not r.is_valid and r.severity == severity]

    @property
    def is_valid(self) -> bool:
        return not self.errors

    @property
    def errors(self) -> list[ValidationResult]:
        return self._failed("error")

    @property
    def warnings(self) -> list[ValidationResult]:
        return self._failed("warning")

    def add(self, result: ValidationResult) -> None:
        self.results.append(result)

    def summary(self) -> str:
        passed = sum(r.is_valid for r in self.results)
        lines = [f"{passed} of {len(self.results)} checks passed, {len(self.errors)} errors, {len(self.warnings)} warnings"]
        lines += [f"{kind}: {r.check_name}: {r.message}" for kind, found in (("error", self.errors), ("warning", self.warnings)) for r in found]
        return "\n".join(lines)


@dataclass(frozen=True)
class _Check:
    """A check as aggregates over the frame: ``bad`` counts violations, the rest are details.

    ``before`` adds columns that need the row before: expressions of ``_prev`` and the column.
    """

    name: str
    columns: tuple[str, ...]
    bad: Column
    details: dict[str, Column] = field(default_factory=dict)
    severity: str = "error"


def _with_previous(frame: EventFrame, columns: list[str]) -> DataFrame:
    """The columns, time in microseconds and the values of the row before (``{col}_before``)."""
    order = event_order(frame)
    df, window = sequenced(frame.df.select(*dict.fromkeys([*order, *columns])), [], order, columns, 1)
    made = {f"{c}_before": F.lag(c).over(window) for c in columns}
    df = df.withColumns({**made, "_us": micros(order[0]), "_us_before": F.lag(micros(order[0])).over(window)})
    return own_rows(df, [*dict.fromkeys([*order, *columns]), *made, "_us", "_us_before"])


def run_checks(frame: EventFrame, checks: list[_Check], ordered: list[str] = ()) -> list[ValidationResult]:
    """All checks in one job; a check whose columns are missing fails."""
    there = set(frame.df.columns)
    able = [c for c in checks if set(c.columns) <= there]
    found: dict[str, Any] = {}
    if able:
        df = _with_previous(frame, [c for c in ordered if c in there]) if ordered else frame.df
        aggs = [x for i, c in enumerate(able) for x in (F.coalesce(c.bad.cast("long"), F.lit(0)).alias(f"b{i}"), *(d.alias(f"d{i}_{k}") for k, d in c.details.items()))]
        found = df.agg(*aggs).first().asDict()
    out = []
    for c in checks:
        if c not in able:
            out.append(ValidationResult(False, c.name, f"columns are missing: {sorted(set(c.columns) - there)}", severity=c.severity))
            continue
        i = able.index(c)
        bad = found[f"b{i}"]
        details = {k: found[f"d{i}_{k}"] for k in c.details} | {"n_violations": bad}
        out.append(ValidationResult(bad == 0, c.name, "passed" if bad == 0 else f"{bad} violations", details, c.severity))
    return out


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _positive(name: str, col: str, allow_zero: bool) -> _Check:
    return _Check(name, (col,), _count(F.col(col) < 0 if allow_zero else F.col(col) <= 0), {"min": F.min(col)})


def validate_intensity_positivity(event_frame: EventFrame, intensity_col: str = "intensity", allow_zero: bool = True) -> ValidationResult:
    return run_checks(event_frame, [_positive("intensity_positivity", intensity_col, allow_zero)])[0]


def validate_hazard_positivity(event_frame: EventFrame, hazard_col: str = "hazard", allow_zero: bool = True) -> ValidationResult:
    return run_checks(event_frame, [_positive("hazard_positivity", hazard_col, allow_zero)])[0]


def validate_inter_event_positivity(event_frame: EventFrame, inter_event_col: str = "inter_event", allow_zero: bool = False) -> ValidationResult:
    return run_checks(event_frame, [_positive("inter_event_positivity", inter_event_col, allow_zero)])[0]


def _integrable(col: str, most: float) -> _Check:
    area = F.sum((F.col("_us") - F.col("_us_before")) / F.lit(2e6) * (F.col(col) + F.col(f"{col}_before")))
    return _Check("intensity_integrability", (col,), F.when(F.coalesce(area, F.lit(0.0)) < most, 0).otherwise(1), {"integral": area})


def validate_intensity_integrability(event_frame: EventFrame, intensity_col: str = "intensity", max_integral: float = 1e10) -> ValidationResult:
    """The area under the intensity, by trapezoids in seconds, is below the bound."""
    return run_checks(event_frame, [_integrable(intensity_col, max_integral)], [intensity_col])[0]


def validate_probability_bounds(event_frame: EventFrame, prob_col: str = "probability", tolerance: float = 1e-6) -> ValidationResult:
    p = F.col(prob_col)
    return run_checks(event_frame, [_Check("probability_bounds", (prob_col,), _count((p < -tolerance) | (p > 1 + tolerance)), {"min": F.min(p), "max": F.max(p)})])[0]


def _monotone(col: str, tolerance: float) -> _Check:
    rise = F.col(col) - F.col(f"{col}_before")
    return _Check("survival_monotonicity", (col,), _count(rise > tolerance), {"max_increase": F.max(rise)})


def validate_survival_monotonicity(event_frame: EventFrame, survival_col: str = "survival", tolerance: float = 1e-6) -> ValidationResult:
    return run_checks(event_frame, [_monotone(survival_col, tolerance)], [survival_col])[0]


def validate_cumulative_hazard_start(event_frame: EventFrame, hazard_col: str = "cumulative_hazard", tolerance: float = 1e-6) -> ValidationResult:
    """The first value is not negative (a warning)."""
    first = F.min_by(hazard_col, F.struct(*event_order(event_frame)))
    return run_checks(event_frame, [_Check("cumulative_hazard_start", (hazard_col,), F.when(first < -tolerance, 1).otherwise(0), {"first": first}, "warning")])[0]


def validate_survival_boundaries(event_frame: EventFrame, survival_col: str = "survival", tolerance: float = 1e-6) -> ValidationResult:
    """The first value is at most 1, the last not negative."""
    order = F.struct(*event_order(event_frame))
    first, last = F.min_by(survival_col, order), F.max_by(survival_col, order)
    bad = F.when((first > 1 + tolerance) | (last < -tolerance), 1).otherwise(0)
    return run_checks(event_frame, [_Check("survival_boundaries", (survival_col,), bad, {"first": first, "last": last})])[0]


def validate_hawkes_stability(alpha: float, beta: float, branching_ratio: float | None = None) -> ValidationResult:
    """alpha / beta, or the given ratio, is below 1."""
    if branching_ratio is None:
        if beta <= 0:
            return ValidationResult(False, "hawkes_stability", "beta must be positive", {"alpha": alpha, "beta": beta})
        branching_ratio = alpha / beta
    ok = branching_ratio < 1
    return ValidationResult(ok, "hawkes_stability", "passed" if ok else "the process explodes", {"branching_ratio": branching_ratio, "alpha": alpha, "beta": beta})


def _hawkes(intensity: str, background: str) -> _Check:
    low = F.col(intensity) < F.col(background) - 1e-12
    return _Check("hawkes_intensity", (intensity, background), _count(low | (F.col(intensity) < 0)), {"min": F.min(intensity)})


def validate_hawkes_intensity(event_frame: EventFrame, intensity_col: str = "hawkes_intensity", background_col: str = "hawkes_background") -> ValidationResult:
    return run_checks(event_frame, [_hawkes(intensity_col, background_col)])[0]


def validate_temporal_ordering(event_frame: EventFrame, timestamp_col: str | None = None, sequence_col: str | None = None) -> ValidationResult:
    """Times do not fall in the order of ``sequence_col`` (default: the id). Rows have no order of their own."""
    ts = timestamp_col or event_frame.schema.timestamp_col
    seq = sequence_col or event_frame.schema.id_col
    if ts not in event_frame.df.columns or not seq or seq not in event_frame.df.columns:
        return ValidationResult(False, "temporal_ordering", "a timestamp and a sequence column are needed")
    # out of order if some earlier block, or an earlier row of the block, has a later time; blocks need a number
    df = event_frame.df.select(F.col(seq).alias("_q"), micros(ts).alias("_us"))
    if dict(df.dtypes)["_q"] not in ("int", "bigint"):
        raise ValueError("the sequence column must be an integer")
    df = df.withColumn("_b", F.floor(F.col("_q") / 65536))
    per = df.groupBy("_b").agg(F.max("_us").alias("_most"))
    per = per.select(F.col("_b").alias("_c"), F.max("_most").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    here = F.max("_us").over(Window.partitionBy("_b").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1))
    joined = df.withColumn("_here", here).join(per, F.col("_b") == F.col("_c"))
    bad = joined.agg(_count(F.greatest("_here", "_before") > F.col("_us"))).first()[0]
    return ValidationResult(bad == 0, "temporal_ordering", "passed" if bad == 0 else f"{bad} rows are out of order", {"n_violations": bad})


def validate_point_process_features(event_frame: EventFrame, intensity_col: str | None = None, survival_col: str | None = None, hazard_col: str | None = None, inter_event_col: str | None = None) -> ValidationReport:
    """All checks of the given columns, in one job, or two if some need the row before; their input is computed once."""
    plain, ordered, names = [], [], []
    wanted = [c for c in (intensity_col, survival_col, hazard_col, inter_event_col) if c in event_frame.df.columns]
    if intensity_col or survival_col:
        event_frame = event_frame.with_df(staged(event_frame.df.select(*dict.fromkeys([*event_order(event_frame), *wanted]))))
    if intensity_col:
        plain.append(_positive("intensity_positivity", intensity_col, True))
        ordered.append(_integrable(intensity_col, 1e10))
        names.append(intensity_col)
    if survival_col:
        p = F.col(survival_col)
        plain.append(_Check("probability_bounds", (survival_col,), _count((p < -1e-6) | (p > 1 + 1e-6)), {"min": F.min(p), "max": F.max(p)}))
        ordered.append(_monotone(survival_col, 1e-6))
        names.append(survival_col)
    if hazard_col:
        plain.append(_positive("hazard_positivity", hazard_col, True))
    if inter_event_col:
        plain.append(_positive("inter_event_positivity", inter_event_col, False))
    return ValidationReport([*run_checks(event_frame, plain), *(run_checks(event_frame, ordered, names) if ordered else [])])


def validate_hawkes_features(event_frame: EventFrame, alpha: float, beta: float, intensity_col: str = "hawkes_intensity", background_col: str = "hawkes_background") -> ValidationReport:
    checks = [_positive("intensity_positivity", intensity_col, True), _hawkes(intensity_col, background_col)]
    return ValidationReport([validate_hawkes_stability(alpha, beta), *run_checks(event_frame, checks)])


def report_frame(event_frame: EventFrame, report: ValidationReport) -> DataFrame:
    """A report as a DataFrame: check_name, is_valid, severity, n_violations."""
    rows = [(r.check_name, r.is_valid, r.severity, r.details.get("n_violations")) for r in report.results]
    return event_frame.df.sparkSession.createDataFrame(rows, "check_name string, is_valid boolean, severity string, n_violations long")
