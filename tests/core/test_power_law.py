"""The power-law intensity sums over all earlier events, however many."""

from datetime import timedelta

import numpy as np

from chronomesh.operators import point_process as P
from chronomesh.operators.point_process import ConditionalIntensityStep
from tests.conftest import START


def test_beyond_ten_thousand(make):
    n = 12_000
    at = np.sort(np.random.default_rng(1).integers(0, 9000, n)).tolist()  # dense, with ties
    frame = make([{"ts": START + timedelta(seconds=s), "id": k} for k, s in enumerate(at)])
    got = {r.id: r.conditional_intensity for r in ConditionalIntensityStep("power_law").run(frame).df.collect()}
    assert len(got) == n
    hours = np.array(at) / 3600
    for k in (1, 500, 4097, 10_000, 10_001, 11_000, n - 1):
        want = ((1 + hours[k] - hours[:k]) ** -2).sum()
        assert abs(got[k] - want) < 1e-9 * want


def test_far_times_enter_as_decaying_sums(make):
    """Chunks do not meet each other one by one, and sums over years keep their digits."""
    n = 3 * P.CHUNK + 5
    rng = np.random.default_rng(2)
    at = np.sort(np.concatenate([rng.integers(0, 9_000_000, n // 2), 50_000_000_000 + rng.integers(0, 60_000_000_000_000, n - n // 2)]))  # microseconds
    frame = make([{"ts": START + timedelta(microseconds=int(s)), "id": k} for k, s in enumerate(at)])
    sums = P._power_law_sums(frame.df, "ts", 3600.0)
    plan = sums._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sums.count() == len(set(at.tolist()))
    got = {r.id: r.conditional_intensity for r in ConditionalIntensityStep("power_law").run(frame).df.collect()}
    hours = at / 3.6e9
    for k in (1, 255, 256, 257, 4096, 4097, n // 2, n // 2 + 1, 2 * P.CHUNK + 1, n - 1):
        want = ((1 + (hours[k] - hours[:k])) ** -2).sum()
        assert abs(got[k] - want) < 1e-12 * want
    rates, weights = P._power_law_terms(1e6)
    for g in (0.0, 0.001, 1.0, 37.3, 9e3, 1e6):
        assert abs((weights * np.exp(-rates * g)).sum() * (1 + g) ** 2 - 1) < 1e-13
