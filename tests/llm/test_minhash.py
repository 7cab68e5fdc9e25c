from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from relspark.llm import minhash
from relspark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text) -> frozenset:
    words = WORD.findall(lowered(text or ""))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(words)


def brute(rows) -> dict:
    """Component of each id by comparing all pairs."""
    sets = {i: shingles(t) for i, t in rows if i is not None}
    label = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common) and label[a] != label[b]:
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    return label


def corpus(seed: int, groups: int = 8) -> list:
    """Groups of near copies, chains that only reach by steps, shared passages, noise."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    passage = rng.choices(vocabulary, k=60)
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.choice([3, 6, 20, 80, 150]))
        for _ in range(rng.choice([1, 2, 5, 30])):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
        for _ in range(5):  # a chain: each step changes a little more
            base = list(base)
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(" ".join(base))
    texts += [" ".join(passage + rng.choices(vocabulary, k=rng.randint(5, 40))) for _ in range(40)]
    texts += [" ".join(rng.choices(vocabulary[:50], k=rng.randint(1, 6))) for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "chunk"), [(1, 256), (2, 16)])
def test_against_all_pairs(documents, monkeypatch, seed, chunk):
    """With small chunks, clusters need all rounds of confirmation."""
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    monkeypatch.setattr(minhash, "CELL", chunk)
    monkeypatch.setattr(minhash, "CHUNK_SHINGLES", chunk * 1000)
    rows = corpus(seed)
    expected = brute(rows)
    found = minhash.classes(documents(rows)).collect()
    assert {r.doc_id: r.component_id for r in found} == expected
    assert len(set(expected.values())) < len(rows) - 20
    assert {r.doc_id: r.n_shingles for r in found} == {i: len(shingles(t)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_awkward_rows(awkward):
    found = minhash.classes(awkward).collect()
    assert len(found) == 13
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert by_id[1] == [(21, 1, True)] * 2
    assert by_id[2] == [(21, 1, False)]
    assert by_id[3] == [(0, 3, True)]
    assert by_id[4] == [(0, 4, True)]
    assert by_id[5] == [(0, 5, True)]
    assert by_id[7][0][1:] == (6, False)
    assert sorted(by_id[None]) == [(0, None, False), (22, None, False)]
    assert by_id[8] == [(1, 8, True)]


def test_deduplicate_keeps_one_of_each(awkward):
    found = minhash.deduplicate(awkward)
    assert found.columns == awkward.columns
    assert sorted((r.doc_id for r in found.collect()), key=str) == sorted([1, 3, 4, 5, 6, 8, 9, 10, None, None], key=str)


def test_empty_table(documents):
    assert minhash.classes(documents([])).count() == 0
    assert minhash.deduplicate(documents([])).count() == 0


def test_links_within_skips_connected_and_same_side():
    sets = [np.arange(10, dtype=np.uint64), np.arange(10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64), np.arange(50, 60, dtype=np.uint64)]
    alone = minhash.links_within(sets, np.arange(4), np.full(4, -1))
    assert {frozenset(x) for x in alone} == {frozenset((0, 1)), frozenset((0, 2))}
    assert minhash.links_within(sets, np.array([0, 0, 0, 1]), np.full(4, -1)) == []
    assert {frozenset(x) for x in minhash.links_within(sets, np.arange(4), np.array([0, 0, 1, 1]))} == {frozenset((0, 2)), frozenset((1, 2))}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    a, b = np.unique(pool[:900]), np.unique(pool[100:])
    same = (minhash.signature(a) == minhash.signature(b)).mean()
    assert abs(same - 0.8) < 0.2


def test_components_of_random_graphs(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 100)]
    label = {x: x for e in edges for x in e}
    for u, v in edges * 70:
        label[u] = label[v] = min(label[u], label[v])
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {x: c for x, c in label.items() if x != c}


def test_the_stage_links_by_five_words(spark, documents, monkeypatch):
    """One changed word in 25 leaves 0.85 of the pairs of words and 0.67 of the fives."""
    import corpus_pipeline

    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([2, 4, 5, 8, 9, 100, 200]))]
        rows.append(" ".join(base))
        rows.append(" ".join(w if i % 25 else f"x{g}" for i, w in enumerate(base)))
        rows.append(" ".join(base + ["tail"]))
        rows.append(" ".join(base))
    rows = list(enumerate(rows))

    def fives(text) -> frozenset:
        words = WORD.findall(lowered(text or ""))
        return frozenset(zip(*(words[i:] for i in range(5)), strict=False)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])

    two = brute(rows)
    with monkeypatch.context() as m:
        m.setitem(globals(), "shingles", fives)
        five = brute(rows)
    assert two != five
    found = corpus_pipeline.near_duplicates_stage(spark, documents(rows), "").collect()
    assert sorted(r.doc_id for r in found) == sorted(set(five.values()))


def test_repeated_rows_of_one_id_are_confirmed_once(documents, monkeypatch):
    """Cells stay within CHUNK sets, whatever the rows of an id."""
    words = [f"w{i}" for i in range(60)]
    rows = [(7, " ".join(words))] * 300 + [(9, " ".join([*words[:-1], "other"]))]
    sizes = []
    original = minhash.cut

    def spy(df, label):
        out = original(df, label)
        if label == "clustered":
            sizes.append(out.count())
        return out

    monkeypatch.setattr(minhash, "cut", spy)
    found = minhash.classes(documents(rows)).collect()
    assert sizes == [2]
    assert {(r.doc_id, r.component_id) for r in found} == {(7, 7), (9, 7)}
    assert len(found) == 301


def test_different_texts_of_one_id_are_documents_of_their_own(documents):
    """Only rows that are copies of others go, whatever their ids."""
    rng = random.Random(4)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, b + " tail"), (3, c), (3, ""), (3, None), (3, None), (None, c), (None, d), (4, c), (4, d)]
    found = sorted((r.doc_id or 0, "-" if r.text is None else r.text) for r in minhash.deduplicate(documents(rows)).collect())
    kept = Counter(t.removesuffix(" tail") for _, t in found)
    # Rows without an id stay; of c, one with an id stays; of b, one of the near copies.
    assert kept == {a: 1, b: 1, c: 2, d: 2, "": 1, "-": 1}
    again = sorted((r.doc_id or 0, "-" if r.text is None else r.text) for r in minhash.deduplicate(documents(rows[::-1]).repartition(5)).collect())
    assert again == found


def alike(rng, n: int) -> np.ndarray:
    """Low bytes of n signatures, each half its group's."""
    base = rng.integers(0, 256, minhash.COORDINATES, dtype=np.uint8)
    low = np.tile(base, (n, 1))
    for row in low:
        row[rng.choice(minhash.COORDINATES, 20, replace=False)] += 1 + rng.integers(0, 200, dtype=np.uint8)
    return low


def joined_by_all_pairs(low: np.ndarray, labels: list) -> dict:
    """Each label's smallest after all pairs that agree in MATCHES bytes."""
    root = {x: x for x in labels}
    for i in range(len(low)):
        for j in np.flatnonzero((low[i + 1 :] == low[i]).sum(1) >= minhash.MATCHES) + i + 1:
            a, b = sorted((root[labels[i]], root[labels[j]]))
            root = {x: a if r == b else r for x, r in root.items()} if a != b else root
    return root


@pytest.mark.parametrize("batch", [7, 100, 10_000])
def test_cells_tell_components_not_pairs(batch):
    """Members of a hot list that all collide make fewer rows than there are members."""
    rng = np.random.default_rng(11)
    low = np.concatenate([alike(rng, 600), alike(rng, 40), alike(rng, 1), alike(rng, 1)])
    cell = np.arange(len(low)) >= 630  # the second group lies in two cells
    labels = [100 + i // 3 for i in range(len(low))]
    columns = {"cell": cell.astype(np.int64), "rep": np.arange(len(low)), "n": np.full(len(low), 50, np.int32), "component": np.array(labels), "side": np.full(len(low), -1, np.int32), "low": [r.tobytes() for r in low]}
    found = [(x, y) for b in minhash._cells(iter(pa.table(columns).to_batches(max_chunksize=batch))) for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist(), strict=True)]
    assert len(found) < 2 * len(set(labels))
    root = {x: x for x in labels}
    for x, y in found:
        assert x < y
        a, b = sorted((root[x], root[y]))
        root = {k: a if r == b else r for k, r in root.items()}
    first, second = joined_by_all_pairs(low[:630], labels[:630]), joined_by_all_pairs(low[630:], labels[630:])
    expected = {x: x for x in labels}
    for k, r in [*first.items(), *second.items()]:
        a, b = sorted((expected[k], expected[r]))
        expected = {x: a if y == b else y for x, y in expected.items()}
    assert root == expected
    assert 2 < len(set(root.values())) < 8


def test_large_lists_meet_in_proportion_to_their_size(spark, monkeypatch):
    """A list of many cells: what collides ends in one component, even where only members outside
    the largest one do, and rows sent don't go by the square."""
    monkeypatch.setattr(minhash, "CELL", 32)
    sent, original = [], minhash._met

    def spy(rows, low):
        sent.append(rows.count())
        return original(rows, low)

    monkeypatch.setattr(minhash, "_met", spy)
    rng = np.random.default_rng(12)
    low = np.concatenate([alike(rng, 1200), *(alike(rng, 2) for _ in range(10))])
    for k in range(8):  # a chain: of neighbours only do 40 bytes agree
        step = low[-1].copy()
        step[(np.arange(24) + 24 * k) % minhash.COORDINATES] += 1
        low = np.concatenate([low, step[None]])
    reps = [int(i) for i in rng.permutation(len(low))]
    postings = spark.createDataFrame([(5, r, 50) for r in reps], "token long, rep long, n int")
    lows = spark.createDataFrame([(r, 50, bytearray(x.tobytes())) for r, x in zip(reps, low, strict=True)], "rep long, n int, low binary")
    found = {r.node: r.component for r in minhash.merged_lists(postings, lows, spark.createDataFrame([], "node long, component long")).collect()}
    expected = joined_by_all_pairs(low, reps)
    assert {r: found.get(r, r) for r in reps} == expected
    assert 8 < len(set(expected.values())) < 30
    assert len(sent) == 3
    assert sum(sent) < 6 * len(reps)  # in cells of all chunks' pairs: 39 times as many as members
