from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from relspark.llm import boosting


def test_trees_learn_a_boundary():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(boosting.NAMES))).astype(np.float32)
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert ((model.scores(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95


def test_flat_walk_equals_recursion():
    rng = np.random.default_rng(1)
    x = rng.random((500, 3)).astype(np.float32)
    model = boosting.fit(x, (x[:, 0] * x[:, 1] > 0.2).astype(float), trees=7, depth=3)

    def walk(t, row, node=0):
        if node >= 7:
            return model.value[t, node - 7]
        f = model.feature[t, node]
        return walk(t, row, 2 * node + 1 + (f >= 0 and row[f] > model.threshold[t, node]))

    expected = [model.start + sum(walk(t, r) for t in range(7)) for r in x]
    assert np.allclose(model.margins(x), expected)


def test_statistics_by_hand():
    texts = ["Hello, hello world!\n#1 é\nHello, hello world!", "", None, "a a a a a a"]
    x = {n: boosting.statistics(texts)[:, i] for i, n in enumerate(boosting.NAMES)}
    assert x["log_words"] == pytest.approx(np.log1p([8, 0, 0, 6]))
    assert x["symbols"] == pytest.approx([1 / 8, 0, 0, 0])
    assert x["line_ends"] == pytest.approx([2 / 8, 0, 0, 0])
    assert x["marks"] == pytest.approx([4 / 8, 0, 0, 0])
    assert x["distinct_words"] == pytest.approx([5 / 8, 1, 1, 1 / 6])
    assert x["top_word"] == pytest.approx([2 / 8, 0, 0, 1])
    assert x["distinct_lines"] == pytest.approx([2 / 3, 1, 1, 1])
    assert x["distinct_pairs"][3] == pytest.approx(1 / 5)


def test_held_out_accuracy(spark, documents):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(600):
        good = rng.random() < 0.7
        words = [word() for _ in range(rng.randint(20, 80))]
        rows.append((i, " ".join(words if good else rng.choice([[w + "%%" for w in words], words[:3] * 20]))))
        labels.append((i, int(good), 0))
    found = boosting.classify(documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = dict((i, q) for i, q, _ in labels)
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)


def test_held_out_labels_teach_nothing(spark, documents):
    rows = [(i, f"word{i} " * (i % 9 + 1)) for i in range(300)]
    label = lambda flip: spark.createDataFrame([(i, (i % 2) ^ (flip and zlib.crc32(str(i).encode()) % 4 == 2), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    scores = [sorted((r.doc_id, r.score) for r in boosting.classify(documents(rows), label(f)).collect()) for f in (False, True)]
    assert scores[0] == scores[1]


def test_awkward_rows_and_no_labels(spark, awkward, documents):
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    found = boosting.classify(awkward, none).collect()
    assert len(found) == 13 and {r.score for r in found} == {0.5}
    some = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (6, 1), (None, 0)], "doc_id long, quality int")
    assert boosting.classify(awkward, some).count() == 13
    assert boosting.classify(documents([]), some).count() == 0


def test_fit_against_sums_over_all_rows(monkeypatch):
    """Each split and leaf by adding up the rows on either side, without histograms."""
    monkeypatch.setattr(boosting, "BINS", 9)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(240, 3)).astype(np.float32)
    x[:, 2] = 1  # nothing to split
    y = (x[:, 0] + 0.5 * rng.normal(size=240) > 0.2).astype(float)
    model = boosting.fit(x, y, trees=4, depth=2)
    margin = np.full(240, np.log((y.sum() + 1) / (241 - y.sum())))
    assert model.start == pytest.approx(margin[0])
    splits = 0
    for t in range(4):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        worth = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + boosting.LAMBDA)
        groups = {0: np.ones(240, bool)}
        for node in range(3):
            rows = groups[node]
            best = (boosting.LEAST_GAIN, -1, 0.0)
            for j in range(3):
                for edge in np.unique(np.quantile(x[:, j], np.arange(1, 9) / 9)).astype(np.float32):
                    left, right = rows & (x[:, j] <= edge), rows & (x[:, j] > edge)
                    if min(h[left].sum(), h[right].sum()) >= boosting.LEAST_WEIGHT / 4:
                        gain = worth(left) + worth(right) - worth(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, j, edge)
            assert (model.feature[t, node], model.threshold[t, node]) == (best[1], pytest.approx(best[2]))
            splits += best[1] >= 0
            goes_right = (x[:, best[1]] > best[2]) & (best[1] >= 0)
            groups[2 * node + 1], groups[2 * node + 2] = rows & ~goes_right, rows & goes_right
        for leaf in range(4):
            rows = groups[3 + leaf]
            value = -boosting.RATE * g[rows].sum() / (h[rows].sum() + boosting.LAMBDA)
            assert model.value[t, leaf] == pytest.approx(value)
            margin[rows] += value
    assert splits > 6


def test_counts_of_a_text_beyond_the_whole_numbers_of_float32():
    n = (1 << 24) + 4
    assert boosting.statistics(["#" * n + "7 a"])[0, 2] == np.float32(n / 2)


def test_an_id_teaches_once_and_by_zero_or_one_alone(spark, documents, monkeypatch):
    rows = [(i, f"word{i} " * (i % 9 + 1)) for i in range(200)]
    labels = [(i, i % 2) for i, _ in rows]
    taught = []
    original = boosting.fit
    monkeypatch.setattr(boosting, "fit", lambda x, y: taught.append((x.tobytes(), y.tolist())) or original(x, y))
    make = lambda some: spark.createDataFrame(some, "doc_id long, quality int")
    boosting.classify(documents(rows), make(labels)).count()
    boosting.classify(documents(rows + rows[:1] * 500), make(labels + [(i, 5) for i in range(200, 300)] + [(3, 1)])).count()
    boosting.classify(documents(rows + [(900, "odd one"), (901, "two")]), make(labels + [(900, 7), (901, -1), (902, 1)])).count()
    assert taught[0] == taught[1] == taught[2]
    assert len(taught[0][1]) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i, _ in rows)
