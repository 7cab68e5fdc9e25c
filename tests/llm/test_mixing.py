from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from relspark.llm import mixing


def corpus(seed: int, sizes: dict) -> list:
    rng = random.Random(seed)
    rows = []
    for source, n in sizes.items():
        rows += [(len(rows) + i, " ".join(["w"] * rng.randint(1, 30)), "en", source) for i in range(n)]
    return rows


def totals(found) -> dict:
    out: dict = {}
    for r in found:
        out.setdefault(r.source, [0, 0, r.budget, r.weight_ppm])
        out[r.source][0] += r.n_tokens
        out[r.source][1] += r.n_tokens * r.copies
    return out


SIZES = {"big": 6000, "mid": 900, "small": 60, None: 300}


def entropy(weights) -> float:
    return -sum(w * math.log(w) for w in weights if w)


@pytest.mark.parametrize(("target", "limit"), [(0.97, 100.0), (0.7, 100.0), (0.97, 4.0), (0.0, 4.0)])
def test_weights_and_budgets(documents, target, limit):
    found = mixing.report(documents(corpus(1, SIZES)), target, limit).collect()
    by = totals(found)
    n = sum(v[0] for v in by.values())
    share = {s: v[0] / n for s, v in by.items()}

    def weights(a: float) -> dict:
        z = sum(p**a for p in share.values())
        return {s: p**a / z for s, p in share.items()}

    grid = [k / 1000 for k in range(1001)]
    flat = max((a for a in grid if entropy(weights(a).values()) >= target * math.log(len(share)) - 1e-9), default=0)
    fits = [a for a in grid if a >= flat and max(weights(a)[s] / share[s] for s in share) <= limit + 1e-9]
    expected = weights(fits[0])
    for s, (tokens, emitted, budget, ppm) in by.items():
        assert ppm / 1e6 == pytest.approx(expected[s], abs=0.003)
        assert budget == ppm * n // 1_000_000
        assert 0 <= budget - emitted <= 30  # short by less than one document
        assert emitted <= (limit + 0.01) * tokens


def test_copies_differ_by_one_within_a_source(documents):
    found = mixing.report(documents(corpus(2, SIZES)), 0.99, 50.0).collect()
    for s in SIZES:
        copies = {r.copies for r in found if r.source == s}
        assert max(copies) - min(copies) <= 1
    assert max(r.copies for r in found) > 1 and min(r.copies for r in found) == 0


def test_mix_covers_every_document_and_repeats_small_sources(documents):
    docs = documents(corpus(3, {"big": 3000, "small": 200}))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    copies = Counter(r.doc_id for r in out.collect())
    assert set(copies) == {r.doc_id for r in docs.collect()}
    small = [copies[r.doc_id] for r in docs.where("source = 'small'").collect()]
    assert max(copies.values()) <= 2 and sum(small) > 1.8 * len(small)
    assert {copies[r.doc_id] for r in docs.where("source = 'big'").collect()} == {1}


def test_awkward_rows_and_empty_tables(awkward, documents):
    found = mixing.report(awkward).collect()
    assert len(found) == 13
    assert all(r.copies == 1 for r in mixing.report(documents([(1, ""), (2, None)])).collect())
    assert mixing.report(documents([])).count() == 0
    out = mixing.mix(awkward)
    assert out.columns == awkward.columns
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in awkward.collect()}
    assert mixing.mix(documents([])).count() == 0


def test_no_python_in_the_plans(documents):
    for df in (mixing.report(documents(corpus(4, {"a": 50}))), mixing.mix(documents(corpus(4, {"a": 50})))):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("tiny", [500, 40])
def test_covering_budgets_of_a_tiny_source_beside_huge_ones(spark, tiny):
    """A weight below a millionth still gives passes, within the limit."""
    sizes = {"=a": 1_500_000_000, "=b": 1_600_000_000, "=c": 1_700_000_000, "=tiny": tiny, "=": 0}
    table = spark.createDataFrame([(s, max(n // 100, 1), n) for s, n in sizes.items()], "source string, rows long, tokens long")
    found = {r.source: r for r in mixing.weights(table, 0.97, 2.0, cover=True).collect()}
    assert found["=tiny"].weight_ppm == 0
    n = sum(sizes.values())
    power = {s: (v / n) ** (found[s].exponent / mixing.GRID) for s, v in sizes.items() if v}
    least = min(power[s] / sizes[s] for s in power)
    for s, v in sizes.items():
        passes = min(power[s] / v / least, 2.0) if v else 1.0
        assert found[s].budget == pytest.approx(passes * v, rel=1e-9, abs=1)
        assert v <= found[s].budget <= 2 * v


@pytest.mark.parametrize(("target", "limit", "cover"), [(0.97, 4.0, False), (0.97, 2.0, True), (0.9, 1e9, False), (1.0, 1e9, True), (0.0, 1.0, False)])
def test_many_sources_against_plain_bisection(spark, target, limit, cover):
    """Thousands of sources of very unequal sizes; no array of them is made."""
    rng = random.Random(6)
    sizes = {f"={i}": int(rng.paretovariate(0.6)) for i in range(3000)} | {"=none": 0}
    table = spark.createDataFrame([(s, 1, n) for s, n in sizes.items()], "source string, rows long, tokens long").repartition(7)
    found = mixing.weights(table, target, limit, cover)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    exponents = {r.exponent for r in found.collect()}
    n = sum(sizes.values())
    p = [v / n for v in sizes.values() if v]

    def repeats(k: int) -> float:
        rates = [x ** (k / mixing.GRID - 1) for x in p]
        return max(rates) / (min(rates) if cover else sum(x ** (k / mixing.GRID) for x in p))

    def even(k: int) -> bool:
        w = [x ** (k / mixing.GRID) for x in p]
        return entropy([x / sum(w) for x in w]) >= target * math.log(len(p)) - 1e-9

    def first_false(holds, low: int, high: int) -> tuple:
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if holds(middle) else (low, middle)
        return low, high

    flat = mixing.GRID if even(mixing.GRID) else first_false(even, 0, mixing.GRID)[0]
    expected = flat if repeats(flat) <= limit + 1e-9 else first_false(lambda k: repeats(k) > limit + 1e-9, flat, mixing.GRID)[1]
    assert exponents == {expected}
