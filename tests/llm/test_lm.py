from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from relspark.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text) -> list:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(low), None]


def held_out(i) -> bool:
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def corpus(seed: int, n: int = 400) -> list:
    """Two languages, each text in one, with words beyond any vocabulary."""
    rng = random.Random(seed)
    languages = [[a + b for a in "bdfg" for b in ("a", "io", "u")], [a + b for a in "klmn" for b in ("eh", "oi", "az")]]
    rows = []
    for i in range(n):
        words = rng.choice(languages)
        text = " ".join(rng.choice(words) if rng.random() < 0.9 else f"Rare{rng.randint(0, 4000)}" for _ in range(rng.randint(1, 120)))
        rows.append((i, text))
    return rows


def fresh(seed: int = 0) -> lm.Weights:
    rng = np.random.default_rng(seed)
    return {k: v.astype(np.float64) for k, v in lm.fresh_weights(rng.integers(1, 1000, 1024)).items()}


def test_gradients_by_differences():
    rng = np.random.default_rng(1)
    w = fresh()
    steps = [rng.integers(0, 1024, a) for a in (5, 5, 4, 2, 2, 1)]
    h0 = rng.normal(0, 0.3, (5, lm.HIDDEN))
    count = sum(map(len, steps))
    grads, _, total = lm.gradients(w, h0, steps)

    def loss() -> float:
        return -lm.gradients(w, h0, steps)[2] / count

    assert abs(loss() + total / count) < 1e-12
    for name in w:
        flat, g = w[name].reshape(-1), grads[name].reshape(-1)
        for at in np.argsort(-np.abs(g))[:3]:
            old = flat[at]
            flat[at] = old + 1e-5
            up = loss()
            flat[at] = old - 1e-5
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at])) + 1e-5, name


def test_probabilities_sum_to_one():
    w = fresh()
    h = np.random.default_rng(2).normal(0, 1, (1, lm.HIDDEN)).repeat(1024, 0)
    assert abs(np.exp(lm.log_likelihood(w, h, np.arange(1024))).sum() - 1) < 1e-9


def test_state_is_carried_across_windows_and_lanes():
    """Lanes of different lengths give what one document alone gives, step by step."""
    rng = np.random.default_rng(3)
    w = fresh()
    docs = [rng.integers(0, 1024, n) for n in (1, 40, 200, 33, 32, 5)]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    together = lm.score(w, np.concatenate(docs), offsets)
    for d, s in zip(docs, together, strict=True):
        h, alone = np.zeros((1, lm.HIDDEN)), 0.0
        for x in d:
            alone += lm.log_likelihood(w, h, np.array([x]))[0]
            h = lm.step(w, h, np.array([x]))[0]
        assert abs(alone - s) < 1e-3 * max(1, abs(alone))


def test_counts_and_base_score(documents, monkeypatch):
    """With a small table, many words take the join."""
    monkeypatch.setattr(lm, "TABLE_WORDS", 40)
    rows = [*corpus(1), (1001, None), (1002, ""), (1003, "UPPER lower É"), (1004, "x" * 3000)]
    found = {r.doc_id: r for r in lm.log_probabilities(documents(rows)).collect()}
    count = Counter(t for i, text in rows if not held_out(i) for t in tokens(text))
    n, v = sum(count.values()), len(count)
    for i, text in rows:
        r, ts = found[i], tokens(text)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(i), len(ts), sum(count[t] > 0 for t in ts), n)
        base = sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert r.score < 0


def test_model_beats_unigram_on_held_out_texts(documents):
    found = [r for r in lm.log_probabilities(documents(corpus(2, 800))).collect() if r.held_out and r.n_tokens > 10]
    assert sum(r.score for r in found) > sum(r.base_score for r in found) + 0.05 * sum(r.n_tokens for r in found)


def test_awkward_rows_and_no_training(awkward, documents):
    found = lm.log_probabilities(awkward).collect()
    assert len(found) == 13
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in found)
    assert lm.log_probabilities(documents([])).count() == 0
    alone = next(i for i in range(100) if held_out(i))
    (only,) = lm.log_probabilities(documents([(alone, "never seen")])).collect()
    assert (only.n_known, only.train_tokens) == (0, 0)
    assert math.isfinite(only.score) and abs(only.base_score) < 1e-9  # 0.5 / 0.5 of nothing seen


class Shared:
    """Stands for a broadcast."""

    def __init__(self, value):
        self.value = value


def lexicon_of(rows) -> lm.Lexicon:
    words, n = np.unique(lm.keys_of([t for _, t in rows])[0], return_counts=True)
    bucket = words & (lm.BUCKETS - 1)
    return lm.Lexicon(words, n, np.bincount(bucket, n, lm.BUCKETS).astype(np.int64), np.bincount(bucket, minlength=lm.BUCKETS))


def looked_up(rows, lex, size=50) -> pa.Table:
    ids, texts = zip(*rows, strict=True)
    table = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string())})
    return pa.Table.from_batches(list(lm._look_up(Shared(lex))(iter(table.to_batches(max_chunksize=size)))))


def grouped(items: list[bytes], groups: list[int], size=50):
    table = pa.table({"group": pa.array(groups, pa.int64()), "items": pa.array(items, pa.binary())})
    return iter(table.to_batches(max_chunksize=size))


def test_partitions_weigh_as_many_tokens_as_they_hold(monkeypatch):
    """Tokens count over all flushes, and once; a task's groups are summed up."""
    rows = [(i, " ".join(["word"] * 39)) for i in range(103)]
    lex = lexicon_of(rows)
    start = lm.fresh_weights(lex.frequency)
    items = looked_up(rows, lex).column("items").to_pylist()
    updates = []
    original = lm.train
    monkeypatch.setattr(lm, "train", lambda w, sequences, o: updates.append(original(w, sequences, o)) or updates[-1])
    for hold, groups, parts in ((400, [0] * 103, 11), (1 << 20, [0] * 103, 1), (1 << 20, [0] * 50 + [4] * 53, 2), (400, [0] * 50 + [4] * 53, 11)):
        monkeypatch.setattr(lm, "HOLD_TOKENS", hold)
        updates.clear()
        (out,) = lm._train(Shared(start), 0.003)(grouped(items, groups))
        assert out.column("tokens").to_pylist() == [103 * 40]
        assert len(updates) == parts
        assert sum(n for _, n in updates) == 103 * 40


def test_groups_of_a_task_are_those_of_tasks_of_their_own():
    rows = corpus(3, 60)
    lex = lexicon_of(rows)
    start = lm.fresh_weights(lex.frequency)
    items = looked_up(rows, lex).column("items").to_pylist()

    def total(*tasks):
        out = [b for t in tasks for b in lm._train(Shared(start), 0.01)(t)]
        return sum(b.column("tokens")[0].as_py() for b in out), sum(np.frombuffer(b.column("weights")[0].as_py()) for b in out)

    one = total(grouped(items, [0] * 20 + [1] * 40))
    two = total(grouped(items[:20], [0] * 20), grouped(items[20:], [1] * 40, size=7))
    assert one[0] == two[0]
    assert np.allclose(one[1], two[1])


def test_training_takes_every_token_of_every_document(monkeypatch):
    """Each document goes to training whole, in one piece and from its first token."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(900)}" for _ in range(n))) for i, n in enumerate([3000, 700, 1, 0, *[90] * 60])]
    lex = lexicon_of(rows)
    taken = []
    original = lm.train
    monkeypatch.setattr(lm, "train", lambda w, sequences, o: (taken.extend(sequences), original(w, sequences, o))[1])
    monkeypatch.setattr(lm, "HOLD_TOKENS", 1000)
    table = looked_up(rows, lex)
    list(lm._train(Shared(lm.fresh_weights(lex.frequency)), 0.003)(grouped(table.column("items").to_pylist(), [i % 3 for i in range(len(rows))])))
    whole = [lex.look_up(lm.keys_of([t])[0])[0].tolist() for _, t in rows]
    assert sorted(s.tolist() for s in taken) == sorted(whole)


def test_every_training_row_is_in_one_round_and_group(documents, monkeypatch):
    """The rounds together train on all tokens of the training documents, once."""
    seen = []
    original = lm.averaged

    def spy(parts, like):
        seen.append(sum(r.tokens for r in parts.collect()))
        return original(parts, like)

    monkeypatch.setattr(lm, "averaged", spy)
    monkeypatch.setattr(lm, "GROUP_TOKENS", 500)
    rows = corpus(7, 300)
    lm.log_probabilities(documents(rows)).collect()
    assert len(seen) == len(lm.ROUNDS)
    assert sum(seen) == sum(len(tokens(t)) for i, t in rows if not held_out(i))


def test_scores_do_not_depend_on_how_the_table_is_split(documents, monkeypatch):
    monkeypatch.setattr(lm, "GROUP_TOKENS", 2000)
    rows = corpus(4, 300)
    one, eight = ({r.doc_id: r.score for r in lm.log_probabilities(documents(rows).repartition(n)).collect()} for n in (1, 8))
    assert one.keys() == eight.keys()
    assert all(abs(one[i] - eight[i]) < 1e-4 * max(1, abs(one[i])) for i in one)


def test_score_by_brute_force():
    """The probability of each word, spelt out from the weights: gates, class, item
    within the class, and the word's share of its bucket."""
    rows = [*corpus(8, 60), (99, None), (100, "unseen0 words1 only2")]
    lex = lexicon_of(rows[:50])
    w = {k: v + np.random.default_rng(9).normal(0, 0.3, v.shape).astype(np.float32) for k, v in lm.fresh_weights(lex.frequency).items()}
    count = Counter(int(k) for k in lm.keys_of([t for _, t in rows[:50]])[0])
    listed = set(sorted(count, key=lambda k: (-count[k], k))[: lm.VOCABULARY])
    frequency = {("word", k): count[k] for k in listed}
    for b in range(lm.BUCKETS):
        frequency["bucket", b] = sum(n for k, n in count.items() if k not in listed and k % lm.BUCKETS == b)
    logs = {}
    table = looked_up(rows, lex)
    for batch in lm._score(Shared(w))(iter(table.select([c for c in table.column_names if c != "rare"]).to_batches(max_chunksize=9))):
        logs |= dict(zip(batch.column("doc_id").to_pylist(), batch.column("score").to_pylist(), strict=True))
    k = lm.HIDDEN
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    items = dict(zip(table.column("doc_id").to_pylist(), table.column("items").to_pylist(), strict=True))
    for i, text in rows:
        h, total = np.zeros(k), 0.0
        for key, x in zip(lm.keys_of([text])[0].tolist(), np.frombuffer(items[i], "<i2").tolist(), strict=True):
            name = ("word", key) if key in listed else ("bucket", key % lm.BUCKETS)
            assert lex.frequency[x] == frequency[name]  # items fall by frequency
            c, at = divmod(x, lm.PER_CLASS)
            for logits, pick in ((h @ w["to_class"] + w["class_bias"], c), (h @ w["to_item"][c] + w["item_bias"][c], at)):
                total += math.log10(np.exp(logits[pick]) / np.exp(logits).sum())
            if name[0] == "bucket":
                words = sum(1 for q in count if q not in listed and q % lm.BUCKETS == name[1])
                # Unseen words' own half counts are added by the join over the whole table.
                total += (math.log10(count[key] + 0.5) if count[key] else 0) - math.log10(frequency[name] + 0.5 * (words + 1))
            r, z = (sigmoid(w["input"][x][s] + h @ w["state"][:, s]) for s in (slice(0, k), slice(k, 2 * k)))
            n = np.tanh(w["input"][x][2 * k :] + r * (h @ w["state"][:, 2 * k :] + w["gate"]))
            h = (1 - z) * n + z * h
        assert abs(total - logs[i]) < 1e-4 * max(1, abs(total)), i


def test_lanes_train_on_whole_documents_with_states_of_their_own(monkeypatch):
    """Documents that share lanes give the likelihood that each gives alone, and
    gradients that don't reach from one into another."""
    monkeypatch.setattr(lm, "LANES", 3)
    rng = np.random.default_rng(6)
    w = fresh()
    docs = [rng.integers(0, 1024, n) for n in (1, 40, 200, 33, 32, 5, 64, 7)]

    class Still:
        def update(self, g):
            pass

    total = []
    original = lm.gradients
    monkeypatch.setattr(lm, "gradients", lambda *a: (out := original(*a), total.append(out[2]))[0])
    assert lm.train(w, docs, Still())[1] == sum(map(len, docs))
    alone = lm.score(w, np.concatenate(docs), np.cumsum([0, *map(len, docs)]))
    assert abs(sum(total) - alone.sum()) < 1e-4 * abs(alone.sum())

    a, b = docs[7], docs[5]
    none = np.zeros(0, np.int64)
    joined = original(w, np.zeros((1, lm.HIDDEN)), [x[None] for x in np.concatenate([a, b])], [np.zeros(1, np.int64) if i in (0, len(a)) else none for i in range(len(a) + len(b))])[0]
    apart = [original(w, np.zeros((1, lm.HIDDEN)), [x[None] for x in d])[0] for d in (a, b)]
    for name in w:
        assert np.allclose(joined[name] * (len(a) + len(b)), apart[0][name] * len(a) + apart[1][name] * len(b), atol=1e-8), name
