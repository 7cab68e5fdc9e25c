from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np

from relspark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)


def vector(c) -> list:
    n, chars, symbols, dup, rep, lines = c
    return [math.floor(100 * math.sqrt(a / max(b, 1))) for a, b in ((chars, n), (symbols, n), (dup, lines), (rep, n))]


def failed(c) -> bool:
    return c[0] < 10 or 100 * c[4] > 20 * c[0]


def estimate(x: np.ndarray) -> tuple:
    """The estimate from single rows, with numpy's linear algebra: of three starts, each
    concentrated until its rows stay the same, that with the least determinant."""
    x = x[np.lexsort(x.T[::-1])].astype(float)
    floors = np.diag(np.square(quality.FLOORS).astype(float))
    low_median = lambda v: np.sort(v, 0)[(len(v) + 1) // 2 - 1]
    middle = low_median(x)
    spread = np.diag((1.4826 * low_median(np.abs(x - middle))) ** 2)
    h = (3 * len(x) + 3) // 4
    best = []
    for start, (mean, cov) in enumerate(((middle, floors), (middle, floors + spread), (x.mean(0), np.cov(x.T, bias=True) + floors))):
        taken = None
        for _ in range(50):
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
            order = np.lexsort((*x.T[::-1], np.floor(d * 1024 + 0.5)))[:h]
            if taken is not None and set(order) == set(taken):
                break
            taken = order
            mean, cov = x[order].mean(0), np.cov(x[order].T, bias=True) + floors
        best.append((np.linalg.det(cov), start, mean, np.linalg.inv(cov)))
    least = min(b[0] for b in best)
    return next(b[2:] for b in best if b[0] <= least * (1 + 1e-9))


def brute(rows) -> dict:
    data = {i: (counts(t), (lang, source)) for i, t, lang, source in rows}
    good = [(vector(c), g) for c, g in data.values() if not failed(c)]
    sizes = Counter(g for _, g in good)
    est = {g: estimate(np.array([v for v, k in good if k == g])) for g, n in sizes.items() if n >= quality.LEAST_ROWS}
    pooled = estimate(np.array([v for v, _ in good]))
    out = {}
    for i, (c, g) in data.items():
        mean, inverse = est.get(g, pooled)
        d = np.array(vector(c)) - mean
        out[i] = (*c[:5], failed(c), bool(not failed(c) and d @ inverse @ d <= quality.CUTOFF))
    return out


def corpus(seed: int) -> list:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 9)))
    rows = []
    for i in range(300):
        words = [word() for _ in range(rng.randint(5, 80))]
        kind = rng.random()
        if kind < 0.1:
            words = [w + rng.choice("#*%") * 2 for w in words]
        elif kind < 0.2:
            words = words[:20] * 2 + words
        text = rng.choice([" ", "\t", "\x0b ", "  "]).join(words)
        lines = [text, *(rng.choices(["same line here", "another\r", "   ", ""], k=rng.randint(0, 5)))]
        rows.append((i, "\n".join(lines), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", None])))
    return rows


def test_against_numpy(documents):
    rows = corpus(1)
    found = {r.doc_id: tuple(r)[1:] for r in quality.report(documents(rows)).collect()}
    expected = brute(rows)
    assert found == expected
    assert 20 < sum(not e[-1] and not e[-2] for e in expected.values())  # outliers beyond the base rules


def test_chi_square_constants():
    """Both follow from the closed forms of even degrees of freedom."""
    beyond4, beyond6 = (lambda x: math.exp(-x / 2) * (1 + x / 2)), (lambda x: math.exp(-x / 2) * (1 + x / 2 + x * x / 8))

    def quantile(share: float) -> float:
        low, high = 0.0, 200.0
        for _ in range(100):
            middle = (low + high) / 2
            low, high = (middle, high) if beyond4(middle) > share else (low, middle)
        return low

    assert abs(quantile(1e-6) - quality.QUANTILE) < 1e-9
    assert abs(0.75 / (1 - beyond6(quantile(0.25))) - quality.CONSISTENCY) < 1e-12


def test_repeated_lines_alone_can_reject(documents):
    """A text of little but one repeated short line, below the base rule's bound on repeated
    words, among texts that repeat none; its other statistics are ordinary."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    rows = [(i, "\n".join(" ".join(word() for _ in range(8)) for _ in range(12)), "en", "a") for i in range(200)]
    rows.append((999, " ".join(word() for _ in range(900)) + "\n" + "\n".join(f"stops\n{word()} {word()} {word()} {word()}\nstops\nstops\nstops" for _ in range(60)), "en", "a"))
    found = {r.doc_id: (r.base_failed, r.kept) for r in quality.report(documents(rows)).collect()}
    assert found[999] == (False, False)
    assert all(found[i] == (False, True) for i in range(200))


def test_awkward_rows(awkward):
    found = {}
    for r in quality.report(awkward).collect():
        found.setdefault(r.doc_id, []).append((r.n_words, r.base_failed, r.kept))
    assert found[1] == [(23, False, True)] * 2
    assert found[3] == found[4] == found[5] == [(0, True, False)]
    assert found[6] == [(60_000, found[6][0][1], found[6][0][2])]
    assert sorted(found[None]) == [(0, True, False), (24, False, True)]


def test_reject_passes_columns_through(awkward):
    out = quality.reject(awkward)
    assert out.columns == awkward.columns
    kept = [r for r in quality.report(awkward).collect() if r.kept]
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted((r.doc_id for r in kept), key=str)
    assert {r._doc for r in out.collect()} == {"d"}


def test_empty_and_hopeless_tables(documents):
    assert quality.report(documents([])).count() == 0
    assert quality.reject(documents([])).count() == 0
    assert [r.kept for r in quality.report(documents([(1, "too short")])).collect()] == [False]


def test_no_python_in_the_plans(documents):
    plan = quality.report(documents(corpus(2)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
