from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from relspark.llm import suffix
from relspark.llm import textkit as tk


def brute(rows, length=100) -> dict:
    """Bytes that a string which starts earlier covers, for each id."""
    starts: dict[bytes, tuple] = {}
    texts = {i: (t or "").encode() for i, t in rows}
    for i in sorted(k for k in texts if k is not None):
        for at in range(len(texts[i]) - length + 1):
            starts.setdefault(texts[i][at : at + length], (i, at))
    out = {}
    for i, raw in texts.items():
        gone = np.zeros(len(raw), bool)
        if i is not None:
            for at in range(len(raw) - length + 1):
                if starts[raw[at : at + length]] != (i, at):
                    gone[at : at + length] = True
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def corpus(seed: int) -> list:
    rng = random.Random(seed)
    letters = "abcdeéü😀 \n"
    noise = lambda n: "".join(rng.choices(letters, k=n))
    passages = [noise(rng.randint(90, 400)) for _ in range(6)]
    rows = [(i, noise(rng.randint(0, 150)) + rng.choice(passages) + noise(rng.randint(0, 80)) + rng.choice(["", *passages])) for i in range(60)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(rows[:10])]  # whole copies
    rows += [(200, "ab " * 200), (201, "x" * 500), (202, "x" * 99), (203, "y" * 100), (204, "y" * 100), (205, ""), (206, None)]
    rows += [(300 + i, noise(40) + passages[0][:130] + noise(40)) for i in range(60)]  # one common passage in many contexts
    rng.shuffle(rows)
    return rows


def result(df) -> dict:
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(documents, seed):
    rows = corpus(seed)
    assert result(suffix.measured(documents(rows))) == brute(rows)


def test_hot_anchors_are_split_exactly(spark, documents, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_RUNS", 5)
    rows = corpus(3)
    original = suffix.repeated_spans
    monkeypatch.setattr(suffix, "repeated_spans", lambda docs: original(docs, hot=5))
    assert result(suffix.measured(documents(rows))) == brute(rows)


def test_frequent_anchors_are_dealt_by_bytes_exactly(documents, monkeypatch):
    rows = corpus(6)
    for frequent, hot in ((2, 20_000), (2, 3), (10**9, 20_000)):
        monkeypatch.setattr(suffix, "FREQUENT", frequent)
        monkeypatch.setattr(suffix, "HOLD_RUNS", 50)  # many rounds, each settling its own repeats
        monkeypatch.setattr(suffix, "BATCH_BYTES", 2000)
        original = suffix.repeated_spans
        with monkeypatch.context() as m:
            m.setattr(suffix, "repeated_spans", lambda docs, original=original, hot=hot: original(docs, hot=hot))
            assert result(suffix.measured(documents(rows))) == brute(rows)


@pytest.mark.parametrize("seed", range(30))
def test_classes_by_interval_expansion(seed):
    """Small alphabets and lengths, so that intervals split in every way."""
    rng = random.Random(seed)
    length = rng.choice([1, 2, 3, 5, 20])
    snippets = [bytes(rng.choices(b"abc"[: rng.choice([1, 2, 3])], k=rng.randint(1, 60))) for _ in range(rng.randint(1, 12))]
    docs = np.array([rng.randint(0, 5) for _ in snippets])
    starts = np.array([i * 1000 for i in range(len(snippets))])
    d, s, n = suffix.repeated_windows(snippets, docs, starts, length)
    found = {(int(a), int(b) + i) for a, b, c in zip(d, s, n) for i in range(c)}
    where: dict = {}
    for x, doc, at in zip(snippets, docs, starts):
        for i in range(len(x) - length + 1):
            where.setdefault(x[i : i + length], []).append((int(doc), int(at) + i))
    assert found == {p for places in where.values() for p in places if p != min(places)}


def test_suffix_order_is_that_of_prefixes():
    rng = np.random.default_rng(0)
    text = np.r_[rng.integers(2, 5, 400), 1, 0].astype(np.uint16)
    order = suffix.suffix_order(text, 50)
    keys = [tuple(text[i : i + 50]) for i in order]
    assert keys == sorted(keys)


def test_runs_cover_every_window_once():
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcd ", k=n)) for n in (0, 50, 99, 100, 101, 700)]
    text, start, count, anchor, cover = suffix.runs(*tk.join_texts(texts))
    seen = sorted((int(t), int(s) + i) for t, s, c in zip(text, start, count) for i in range(c))
    assert seen == [(t, s) for t, x in enumerate(texts) for s in range(len(x) - 99)]


def test_long_texts_are_cut_with_overlap(documents, monkeypatch):
    monkeypatch.setattr(suffix, "BATCH_BYTES", 256)
    rows = corpus(4)[:60]
    pieces = list(suffix._pieces([1], ["z".join(t or "" for _, t in rows).encode()]))
    assert sum(len(p) for _, ps, _ in pieces for p in ps) > 0
    assert result(suffix.measured(documents(rows))) == brute(rows)


def test_awkward_rows(awkward):
    found = {}
    for r in suffix.measured(awkward).collect():
        found.setdefault(r.doc_id, []).append((r.n_removed, r.n_spans))
    assert found[1] == [(0, 0), (0, 0)]  # rows of one id don't repeat each other
    assert found[2] == [(112, 1)]
    assert found[3] == found[4] == [(0, 0)]
    assert found[None] == [(0, 0), (0, 0)]
    assert found[7][0][1] == 1


def test_remove_keeps_columns_and_whole_characters(documents):
    shared = "é" + "é".join(map(str, range(10, 60)))
    docs = documents([(1, "a" + shared + "b"), (2, "c" + shared + "d"), (3, shared), (4, "clean"), (5, None), (6, "")])
    out = suffix.remove(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: ("a" + shared + "b", len(shared) + 2), 2: ("cd", 2), 4: ("clean", 5), 5: (None, None), 6: ("", 0)}


def test_remove_passes_awkward_rows(awkward):
    out = suffix.remove(awkward)
    assert out.columns == awkward.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([1, 1, 3, 4, 5, 6, 7, 8, 9, 10, None, None], key=str)


def test_empty_table(documents):
    assert suffix.measured(documents([])).count() == 0
    assert suffix.remove(documents([])).count() == 0
