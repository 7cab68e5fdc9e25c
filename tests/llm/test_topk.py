from __future__ import annotations

import math
import random

import numpy as np
import pytest

from relspark.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5, step=50):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for q in sorted(usable):
        if q % step == 0:
            v = min(usable[q])
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, ws in usable.items() for w in ws if i != q and len(w) == len(v))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out


def corpus(seed: int, n: int, dim: int):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(n)]
    same = centres[0]
    rows += [(n + i, same) for i in range(80)]  # many equal vectors: ties
    return rows


def found(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], schema)
    return sorted(map(tuple, topk.search(topk.quantised(df), lambda c: c % 50 == 0, 5).collect()))


@pytest.mark.parametrize(("seed", "n", "dim"), [(1, 900, 8), (2, 400, 3)])
def test_against_brute_force(spark, monkeypatch, seed, n, dim):
    """Small blocks and cells, so that queries visit many of them."""
    for name, value in (("BLOCK_ROWS", 16), ("CHUNK_QUERIES", 4), ("CELL_BLOCKS", 5), ("CELL_CHUNKS", 2)):
        monkeypatch.setattr(topk, name, value)
    rows = corpus(seed, n, dim)
    assert found(spark, rows) == brute(rows)


def test_unusable_vectors_lengths_and_sizes(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0]), (1, [0.5, -1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [3.0]), (7, []), (100, []), (None, [1.0, 1.0]), (1, [0.5, -1.0]), (0, [1.0, 2.0])]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(50, [1.0, 1.0])]) == []


def test_large_values_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-3e5, 3e5) for _ in range(4)]) for i in range(120)]
    assert found(spark, rows) == brute(rows)


def test_far_annuli_are_not_visited(monkeypatch):
    """Well separated clusters: the bound rules most blocks out."""
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 4, (20, 8))
    vectors = np.floor(256 * (centres.repeat(50, 0) + rng.normal(0, 0.05, (1000, 8)))).astype(np.int64)
    largest = float((vectors**2).sum(1).max())
    pivots = vectors[::50].astype(float)
    d = topk.distances(vectors.astype(float), pivots, largest)
    near = d.argmin(1)
    blocks = []
    for p in range(20):
        rows = np.flatnonzero(near == p)
        if len(rows):
            blocks.append({"dim": 8, "pivot": p, "low": d[rows, p].min(), "high": d[rows, p].max(), "ids": rows.astype("<i8").tobytes(), "vectors": vectors[rows].astype("<i8").tobytes()})
    visited = []
    original = np.partition
    monkeypatch.setattr(topk.np, "partition", lambda a, *r: (visited.append(a.shape), original(a, *r))[1])
    q, ids, scores = topk.search_cell(blocks, (np.arange(0, 1000, 50), vectors[::50]), pivots, largest, 5)
    assert sum(rows * columns for rows, columns in visited) < 0.6 * 20 * 1000
    for i in range(0, 1000, 50):
        s = vectors @ vectors[i]
        s[i] = -(1 << 60)
        assert sorted(scores[q == i], reverse=True) == sorted(s, reverse=True)[:5]


def test_only_pairs_that_may_matter_are_sent(spark, monkeypatch):
    """Separated clusters: most pairs of blocks and chunks are ruled out on their numbers."""
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "JOIN_BLOCKS", 10)
    counts = []
    original = topk.surviving

    def spy(annuli, reaches):
        out = original(annuli, reaches)
        chunks = reaches.select("chunk").distinct().count()
        counts.append((out.count(), annuli.count() * chunks))
        return out

    monkeypatch.setattr(topk, "surviving", spy)
    rng = random.Random(7)
    rows = []
    for c in range(40):
        centre = [rng.gauss(0, 1) for _ in range(8)]
        size = math.sqrt(sum(x * x for x in centre))
        rows += [(100 * c + i, [4 * x / size + rng.gauss(0, 0.02) for x in centre]) for i in range(40)]
    assert found(spark, rows) == brute(rows)
    ((kept, whole),) = counts
    assert kept < 0.5 * whole


def test_repeated_query_rows_are_no_bound(spark):
    """Rows of the query's own id, pivots all, don't stand for candidates."""
    rows = [(50, [10.0, 0.0])] * 3 + [(i, [10.0 - i, 0.0]) for i in range(1, 8)]
    assert found(spark, rows) == brute(rows)
    many = [(0, [10.0, 0.0])] * 60 + [(i, [10.0 - i / 8, 0.0]) for i in range(1, 48)]
    assert found(spark, many) == brute(many)
