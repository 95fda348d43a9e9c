"""The pipeline's near-duplicate stage against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from chronomesh.llm import simhash


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def alike(a, b):
    a, b = grams(a), grams(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def slow_kept(docs):
    group = {d: d for d, _ in docs}
    for i, (d, t) in enumerate(docs):
        for e, u in docs[:i]:
            if group[d] != group[e] and alike(t, u):
                x, y = group[d], group[e]
                group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
    return {d for d, g in group.items() if d == g}


@pytest.mark.parametrize("small", [False, True])
def test_near_stage(table, prose, monkeypatch, small):
    """Similar pairs more than four bits apart go, as by brute force."""
    monkeypatch.setattr(simhash, "SAMPLE", 1)
    r, docs, common = random.Random(4), [], prose(900, 12)
    for k in range(25):
        words = prose(k, r.randint(30, 150)).split()
        docs.append((len(docs), " ".join(words)))
        for _ in range(4):
            new = list(words)
            for _ in range(r.randint(1, 5)):
                new[r.randrange(len(new))] = "changed"
            docs.append((len(docs), " ".join(new)))
        docs.append((len(docs), prose(k + 300, 20) + " " + common))
    docs += [(len(docs) + k, t) for k, t in enumerate(["", " ", "one two", "One  two", "one two three", None])]
    far = [(i, j) for i, (_, t) in enumerate(docs) for j, (_, u) in enumerate(docs[:i]) if alike(t, u) and bin(simhash.fingerprint((t or "").encode()) ^ simhash.fingerprint((u or "").encode())).count("1") > 4]
    assert len(far) > 20
    kept = corpus_pipeline.near_stage(None, table([*docs, (None, docs[0][1])]), "")
    assert kept.columns == table([]).columns
    assert {x.doc_id for x in kept.collect()} == slow_kept(docs) | {None}
    assert corpus_pipeline.near_stage(None, table([]), "").count() == 0


def test_prefixes_lose_no_pair():
    """In any order sets of similarity 0.8 share a key."""
    r = np.random.default_rng(5)
    for n in [*range(1, 40), 200]:
        base = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        frequent = np.sort(r.choice(base, len(base) // 2, replace=False))
        for drop in range(len(base)):
            other = np.sort(np.concatenate([base[drop:], r.integers(0, 1 << 63, drop // 2, dtype=np.uint64)]))
            if 5 * len(np.intersect1d(base, other)) >= 4 * len(np.union1d(base, other)):
                a, b = (simhash.prefix(s, 0.8, frequent, np.arange(len(frequent)) % 3 + 3) for s in (base, other))
                assert len(np.intersect1d(a, b))


def test_similar_links_by_brute_force():
    """Sets of known overlap, some linked already."""
    r = np.random.default_rng(8)
    sets = []
    for _ in range(12):
        base = r.integers(0, 1 << 63, r.integers(1, 60), dtype=np.uint64)
        for _ in range(6):
            keep = r.random(len(base)) < r.choice([0.8, 0.9, 1.0])
            sets.append(np.unique(np.concatenate([base[keep], r.integers(0, 1 << 63, r.integers(0, 4), dtype=np.uint64), base[:1]])))
    labels = np.arange(len(sets)) // 2
    want = {k: k for k in labels.tolist()}
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(np.intersect1d(a, b)) >= 4 * len(np.union1d(a, b)):
                x, y = want[int(labels[i])], want[int(labels[j])]
                want = {k: min(x, y) if v in (x, y) else v for k, v in want.items()}
    got = simhash._Links()
    for a, b in simhash.similar_links(sets, labels, 0.8):
        got.add(np.array([a]), np.array([b]))
    assert {k: got.root(k) for k in want} == want and len(set(want.values())) > 5


def test_wide_fingerprints_of_similar_sets():
    """The radius holds for similar sets of all sizes and shuts out unrelated ones."""
    r, radius = np.random.default_rng(2), simhash.wide_radius(0.8)
    far = lambda a, b: int(np.bitwise_count(simhash.wide_fingerprint(a) ^ simhash.wide_fingerprint(b)).sum())
    for n in [4, 5, 8, 10, 30, 100]:
        for _ in range(60):
            base = r.integers(0, 1 << 63, n, dtype=np.uint64)
            least = -(-4 * n // 5)  # a subset of this size is just similar enough
            assert far(base, base[:least]) <= radius
            assert far(base, r.integers(0, 1 << 63, n, dtype=np.uint64)) > radius


def test_repeated_keys(table, prose):
    """Two texts under one key are two documents; a repeated row shares the document's fate."""
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (1, b), (2, b), (2, prose(3, 60)), (2, b), (3, a), (4, a + " end")]
    want = [(1, a), (1, b), (2, prose(3, 60))]
    for how in ({}, {"similarity": 0.8, "width": 5}):
        got = simhash.deduplicate(table([r for r in rows if r[0] != 4 or how]), **how)
        assert sorted((x.doc_id, x.text) for x in got.collect()) == sorted(want)
