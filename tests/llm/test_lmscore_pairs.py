"""The model by brute force: pairs seen once count, probabilities sum to one, held-out text scores above the base."""

from __future__ import annotations

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from chronomesh.llm import lmscore


def about(c):
    """Count that a quantised count stands for."""
    if not c:
        return 0.0
    q = 1 + math.floor(math.log(c) / math.log(1.5) + 1e-9)
    low, high = math.ceil(1.5 ** (q - 1)), math.ceil(1.5**q) - 1
    return math.sqrt(low * high) if high > low else float(low)


class Slow:
    """Interpolated pairs over a dictionary."""

    def __init__(self, learnt):
        self.one, self.two = Counter(w for ws in learnt for w in ws), Counter(p for ws in learnt for p in zip([None, *ws], ws))
        self.n, self.v, self.docs = sum(self.one.values()), len(self.one), len(learnt)

    def probability(self, a, b, quantised=True):
        own, history = (self.one[b] + 1) / (self.n + self.v + 1), self.docs if a is None else self.one[a]
        weight = 0.5 if history else 0.0
        c = self.two[a, b]
        return (1 - weight) * own + weight * min(1.0, (about(c) if quantised else c) / max(history, 1))

    def score(self, ws):
        return sum(math.log10(self.probability(a, b)) for a, b in zip([None, *ws], ws))


@pytest.mark.parametrize("most, hot", [(None, 1 << 20), (0, 1 << 20), (0, 40)])
def test_scores_by_brute_force(table, prose, monkeypatch, most, hot):
    monkeypatch.setattr(lmscore, "HOT", hot)
    docs = [(k, prose(k, 40)) for k in range(60)] + [(90, "the same words " * 30), (91, "the same words " * 30), (92, None), (93, "")]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    words = {d: (t or "").split() + [""] for d, t in docs}
    slow = Slow([ws for d, ws in words.items() if not held(d)])
    assert sum(n == 1 for n in slow.two.values()) > 0.5 * len(slow.two)
    got = {x.doc_id: x.score for x in lmscore.digest(table(docs), max_broadcast=most).collect()}
    close = [abs(got[d] - slow.score(ws)) < 1e-6 * abs(slow.score(ws)) for d, ws in words.items()]
    near = [abs(got[d] - slow.score(ws)) < 0.03 * abs(slow.score(ws)) for d, ws in words.items()]
    assert len(got) == len(docs) and sum(close) >= 0.8 * len(close) and sum(near) >= 0.97 * len(near)  # the filter takes a few n-grams for others


def test_probabilities_sum_to_one(prose):
    """Over all words and one unknown, for every history: exactly with exact counts, nearly with quantised ones."""
    slow = Slow([(prose(k % 7, 30) + " a b a c a a").split() + [""] for k in range(40)])
    for a in [None, *slow.one]:
        if a != "":  # nothing follows the end
            every = [*slow.one, "never seen"]
            assert abs(sum(slow.probability(a, b, quantised=False) for b in every) - 1) < 1e-9
            assert abs(sum(slow.probability(a, b) for b in every) - 1) < 0.12


def test_better_than_the_base(spark):
    """On text that was held out."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = [x for x in lmscore.digest(docs).collect() if x.held_out]
    assert got and sum(x.score for x in got) > 1.02 * sum(x.base_score for x in got)  # scores are negative


def test_counts_beyond_32_bits(spark):
    """Counts of tasks that add up to more than 2 ** 32 stay whole."""
    h = np.array([5, 9, lmscore.END], np.uint64)
    part = np.zeros(3, lmscore._COUNT)
    part["h"], part["c"] = np.sort(h), (1 << 32) - 1
    blob = part.tobytes()
    blobs = spark.createDataFrame([(0, blob, b"", blob)] * 5, "shard int, words binary, once binary, pairs binary")
    row = lmscore._merged(blobs, 1).first()
    total = np.frombuffer(row.words, lmscore._TOTAL)
    assert total["c"].tolist() == [5 * ((1 << 32) - 1)] * 3 and row.tokens == 15 * ((1 << 32) - 1)
    assert list(row.levels) == [int(lmscore.quantise(np.array([5 * ((1 << 32) - 1)]))[0])] * 3


def test_packed_hashes():
    """Sorted hashes come back, from less than 8 bytes each; 5.5 where they are dense."""
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 3_000, 200_000):
        h = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        blob = lmscore._packed(h)
        assert (lmscore._unpacked(blob) == h).all() and len(blob) <= 7.2 * len(h) + 40
    edge = np.array([0, 1, (1 << 32) - 1, 1 << 32, (1 << 64) - 1], np.uint64)
    assert (lmscore._unpacked(lmscore._packed(edge)) == edge).all()


@pytest.mark.parametrize("hot", [1 << 20, 40])
def test_disk_of_lookups(spark, prose, monkeypatch, hot):
    """Lookups at the shards write a few bytes for a pair of a text, not a row; scores are those of the broadcast."""
    monkeypatch.setattr(lmscore, "HOT", hot)
    monkeypatch.setattr(lmscore, "UNIT_BYTES", 100_000, raising=False)
    docs = spark.createDataFrame([(k, prose(k, 2_000) if k % 50 else None) for k in range(200)], "doc_id long, text string").repartition(3)
    wrote = []

    def write(df, name, **more):
        wrote.append(put(df, name, **more))
        return wrote[-1]

    put = lmscore.materialize
    monkeypatch.setattr(lmscore, "materialize", write)
    key = lambda x: (x.doc_id, x.n_tokens, x.n_known, round(x.base_score, 6), round(x.score, 6))
    far = sorted(map(key, lmscore.digest(docs, max_broadcast=0).collect()))
    files = [f.removeprefix("file:") for t in wrote for f in t.inputFiles()]
    n_tokens = sum(x[1] for x in far)
    assert sum(os.path.getsize(f) for f in files) < 12 * n_tokens  # some 6; a row for each pair of a text takes 20 and more
    near = sorted(map(key, lmscore.digest(docs, max_broadcast=1 << 40).collect()))
    assert far == near and len(far) == 200
