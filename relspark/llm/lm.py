"""Gated recurrent language model with class-factored output, in numpy.

Counts of all words of all training documents come first. The VOCABULARY most
frequent words, and BUCKETS groups of the other words (by their last two bytes), are
the model's items; items fall by frequency into CLASSES, and an item's probability is
that of its class times that within the class. A word in a bucket is then as likely as
its count among the bucket's words (plus a half), so every text has a probability.

Every text is turned into items once, and the items are kept as a table.

Training: truncated backpropagation through WINDOW steps, the state carried from window
to window from a document's first token to its end. Training documents are dealt by hash
to ROUNDS rounds and, in each, to groups of GROUP_TOKENS tokens or so. In a round every
group starts from the same weights and goes once over every token of its documents, which
follow one another in lanes; the round's result is the groups' mean, weighted by tokens.
So each token is trained on once, and groups depend on the table's rows alone, never on
how it is split. A group has as many lanes as give it UPDATES updates, LANES at most.

Scoring: whole documents, in lanes; the state is carried across windows from a
document's first token to its end. Words beyond the TABLE_WORDS most frequent are
looked up by a join, so the table that is broadcast has a fixed bound.

Nulls: a null text is an empty one, whose only token is the end; a null id belongs to
training (it isn't held out). Repeated rows are scored each. Empty tables give empty
results, a table without training documents is scored by a model of no counts. Other
columns are ignored. Words are told apart by 58-bit hashes. Rows that repeat both id and
text are trained on in one group, in parts of HOLD_TOKENS tokens.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm import textkit as tk
from relspark.llm.common import cut, in_class, shuffle_width

VOCABULARY = 960
BUCKETS = 64
CLASSES = 32
HIDDEN = 16
WINDOW = 16
LANES = 512
#: Updates that a small group is to have; larger ones have more.
UPDATES = 64
TABLE_WORDS = 1 << 18
#: The learning rate of each round.
ROUNDS = (0.01, 0.007, 0.005, 0.003)
GROUP_TOKENS = 1 << 20
#: Tokens that a task holds before it counts, looks up or trains on them.
HOLD_TOKENS = 3 << 19
#: Tokens, of two bytes each, and documents that are scored together.
SCORE_TOKENS = 1 << 22
SCORE_LANES = 1 << 14
SLOT_BITS = 20
END = -BUCKETS  # the key of the end token, in bucket 0
PER_CLASS = (VOCABULARY + BUCKETS) // CLASSES

# ---- tokens -----------------------------------------------------------------


def keys_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the tokens of all texts, each text ended by END, and offsets. The low
    bits of a key are the word's bucket."""
    data, offsets = tk.join_texts(texts, lower=True)
    starts, ends = tk.word_spans(data)
    words = tk.word_hashes(data, starts, ends)
    last = data[ends - 1].astype(np.uint64) * np.uint64(31) + data[np.maximum(ends - 2, starts)]
    keys = ((words & ~np.uint64(BUCKETS - 1)) | last % np.uint64(BUCKETS)).view(np.int64)
    first = tk.words_per_text(starts, offsets)
    return np.insert(keys, first[1:], END), first + np.arange(len(first))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64))], ["word", "n"])

    held, size = [], 0
    for batch in batches:
        keys, _ = keys_of(batch.column("text").to_pylist())
        held.append(keys)
        size += len(keys)
        if size >= HOLD_TOKENS:
            yield out(held)
            held, size = [], 0
    if size:
        yield out(held)


# ---- the network --------------------------------------------------------------

Weights = dict[str, np.ndarray]


def fresh_weights(frequency: np.ndarray) -> Weights:
    """Small random weights; biases make the model begin as the unigram of items."""
    rng = np.random.default_rng(20141003)
    h, items = HIDDEN, CLASSES * PER_CLASS
    f = (frequency.astype(float) + 0.5).reshape(CLASSES, PER_CLASS)

    def draw(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "input": draw(items, 3 * h, scale=0.1),
        "state": draw(h, 3 * h, scale=1 / np.sqrt(h)),
        "gate": np.zeros(h, np.float32),
        "to_class": draw(h, CLASSES, scale=0.1),
        "class_bias": np.log(f.sum(1) / f.sum()).astype(np.float32),
        "to_item": draw(CLASSES, h, PER_CLASS, scale=0.1),
        "item_bias": np.log(f / f.sum(1, keepdims=True)).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place, as (1 + tanh(x / 2)) / 2, which can't overflow."""
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def step(w: Weights, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    """The state after items x, and what backpropagation needs. Arrays are laid out
    column by column, so that each gate is contiguous."""
    k = HIDDEN
    g, a = w["input"].take(x, 0), (w["state"].T @ h.T).T
    a[:, : 2 * k] += g[:, : 2 * k]
    _sigmoid(a[:, : 2 * k])
    r, z, u = a[:, :k], a[:, k : 2 * k], a[:, 2 * k :]
    u += w["gate"]
    n = r * u
    n += g[:, 2 * k :]
    np.tanh(n, out=n)
    new = h - n
    new *= z
    new += n
    return new, (r, z, n, u)


def _softmax(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities and the logarithm of the denominators, in place."""
    top = None
    if x.size and max(x.max(), -x.min()) > 60:  # else exp can't leave its range
        top = x.max(1, keepdims=True)
        x -= top
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], x.dtype)
    x /= total[:, None]
    return x, np.log(total) if top is None else np.log(total) + top[:, 0]


def _by_class(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of items in rising order, and where each class begins there."""
    order = np.argsort(items.astype(np.int16), kind="stable")
    return order, np.searchsorted(items[order], np.arange(CLASSES + 1) * PER_CLASS)


def log_likelihood(w: Weights, h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """ln p(x) of items given states."""
    order, bounds = _by_class(x)
    h, x = h.take(order, 0), x.take(order)
    c, s = x // PER_CLASS, x % PER_CLASS
    logits = h @ w["to_class"]
    logits += w["class_bias"]
    ordered = logits[np.arange(len(x)), c].astype(np.float64)
    ordered -= _softmax(logits)[1]
    for k in np.flatnonzero(np.diff(bounds)):
        mine = slice(bounds[k], bounds[k + 1])
        logits = h[mine] @ w["to_item"][k] + w["item_bias"][k]
        picked = logits[np.arange(len(logits)), s[mine]].astype(np.float64)
        ordered[mine] += picked - _softmax(logits)[1]
    out = np.empty_like(ordered)
    out[order] = ordered
    return out


def gradients(w: Weights, h0: np.ndarray, steps: list[np.ndarray], begins: list[np.ndarray] | None = None) -> tuple[Weights, np.ndarray, float]:
    """Gradients of the mean negative log-likelihood of a window, the state after it,
    and the sum of ln p. steps: the items of each step, of ever fewer lanes; begins: the
    lanes whose document begins at each step, with a state of zeros."""
    k, h = HIDDEN, np.asfortranarray(h0)
    saved, before = [], []
    for t, x in enumerate(steps):
        a = len(x)
        if begins is not None and len(begins[t]):
            h = h.copy("F")
            h[begins[t]] = 0
        before.append(h[:a])
        new, kept = step(w, h[:a], x)
        saved.append(kept)
        h = np.concatenate([new, h[a:]]) if a < len(h) else new
    states, items = np.ascontiguousarray(np.concatenate(before)), np.concatenate(steps)
    scale = np.float32(1 / len(items))
    out = {name: np.zeros_like(v) for name, v in w.items()}
    ones = np.ones(len(items), states.dtype)
    # Output layer, tokens in order of items.
    order, bounds = _by_class(items)
    ordered, sorted_states = items.take(order), states.take(order, 0)
    c, s = ordered // PER_CLASS, ordered % PER_CLASS
    rows = np.arange(len(items))
    logits = sorted_states @ w["to_class"]
    logits += w["class_bias"]
    loss = float(logits[rows, c].sum())
    p, norm = _softmax(logits)
    loss -= float(norm.sum())
    p[rows, c] -= 1
    p *= scale
    out["to_class"] += sorted_states.T @ p
    out["class_bias"] += ones @ p
    d_sorted = p @ w["to_class"].T
    for j in np.flatnonzero(np.diff(bounds)):
        mine = slice(bounds[j], bounds[j + 1])
        here, wanted = sorted_states[mine], s[mine]
        logits = here @ w["to_item"][j]
        logits += w["item_bias"][j]
        at = rows[: len(logits)]
        loss += float(logits[at, wanted].sum())
        p, norm = _softmax(logits)
        loss -= float(norm.sum())
        p[at, wanted] -= 1
        p *= scale
        out["to_item"][j] += here.T @ p
        out["item_bias"][j] += ones[: len(p)] @ p
        d_sorted[mine] += p @ w["to_item"][j].T
    d_states = np.empty_like(d_sorted)
    d_states[order] = d_sorted
    # Back through the steps.
    ends = np.cumsum([len(x) for x in steps])
    d_gates = np.empty((len(items), 3 * k), states.dtype)
    d_inner = np.empty((len(items), k), states.dtype)
    d_h = np.zeros(h0.shape, states.dtype, "F")
    for t in range(len(steps) - 1, -1, -1):
        a = len(steps[t])
        at = slice(ends[t] - a, ends[t])
        r, z, n, u = saved[t]
        d = d_h[:a]
        back = np.empty((a, 3 * k), states.dtype, "F")  # to the products with the state
        d_n = n * n
        np.subtract(1, d_n, out=d_n)
        d_n *= d
        d_n *= 1 - z
        d_r, d_z, inner = back[:, :k], back[:, k : 2 * k], back[:, 2 * k :]
        np.multiply(d_n, r, out=inner)
        np.multiply(inner, u, out=d_r)
        d_r *= 1 - r
        np.subtract(before[t], n, out=d_z)
        d_z *= d
        d *= z  # d_z has had d as it was
        d_z *= z
        d_z *= 1 - z
        d_gates[at, : 2 * k], d_gates[at, 2 * k :], d_inner[at] = back[:, : 2 * k], d_n, inner
        d += (w["state"] @ back.T).T
        d += d_states[at]
        if begins is not None and len(begins[t]):
            d_h[begins[t]] = 0
    out["state"][:, : 2 * k] += states.T @ d_gates[:, : 2 * k]
    out["state"][:, 2 * k :] += states.T @ d_inner
    out["gate"] += ones @ d_inner
    first = np.flatnonzero(np.r_[True, np.diff(ordered) != 0])
    out["input"][ordered[first]] = np.add.reduceat(d_gates.take(order, 0), first)
    return out, h, loss


class Adam:
    def __init__(self, w: Weights, rate: float):
        self.w, self.rate, self.t = w, rate, 0
        self.m = {n: np.zeros_like(v) for n, v in w.items()}
        self.v = {n: np.zeros_like(v) for n, v in w.items()}

    def update(self, g: Weights) -> None:
        self.t += 1
        norm = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
        clip = min(1.0, 1.0 / max(norm, 1e-12))
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for n, x in g.items():
            x *= np.float32(clip)
            self.m[n] += 0.1 * (x - self.m[n])
            self.v[n] += 0.001 * (x * x - self.v[n])
            self.w[n] -= (rate * self.m[n] / (np.sqrt(self.v[n]) + 1e-8)).astype(np.float32)


def lanes_for(tokens: int) -> int:
    """Lanes that give UPDATES updates to so many tokens, or LANES."""
    return min(LANES, max(4, tokens // (UPDATES * WINDOW)))


def train(w: Weights, sequences: list[np.ndarray], optimiser: Adam) -> tuple[int, int]:
    """One pass over the sequences, all whole; returns updates and tokens. Sequences are
    dealt to lanes, the longest first and each to the shortest lane, and follow one
    another there in random order."""
    updates = tokens = 0
    rng = np.random.default_rng(len(sequences))
    room = [(0, i) for i in range(min(lanes_for(sum(map(len, sequences))), len(sequences)))]
    dealt: list[list[np.ndarray]] = [[] for _ in room]
    for s in sorted(sequences, key=len, reverse=True):
        n, i = room[0]
        dealt[i].append(s)
        heapq.heapreplace(room, (n + len(s), i))
    lanes = [[lane[i] for i in rng.permutation(len(lane))] for lane in sorted(dealt, key=lambda lane: -sum(map(len, lane)))]
    lengths = np.array([sum(map(len, lane)) for lane in lanes], np.int64)
    items, starts = np.concatenate([s for lane in lanes for s in lane] or [np.zeros(0, np.int16)]), np.cumsum(lengths) - lengths
    begin = np.zeros(len(items), bool)
    begin[np.cumsum([0, *(len(s) for lane in lanes for s in lane)])[:-1]] = True
    longest = int(lengths[0]) if len(lengths) else 0
    h = np.zeros((len(lanes), HIDDEN), np.float32)
    full = sum(int(np.searchsorted(-lengths, -i, "left")) for i in range(min(WINDOW, longest)))
    waiting, held = None, 0
    for t in range(0, longest, WINDOW):
        active = [int(np.searchsorted(-lengths, -i, "left")) for i in range(t, min(t + WINDOW, longest))]
        at = [starts[:a] + t + i for i, a in enumerate(active)]
        grads, h, _ = gradients(w, h[: active[0]], [items[x] for x in at], [np.flatnonzero(begin[x]) for x in at])
        # Where few lanes are left, windows share an update: each token counts alike.
        n = sum(active)
        for g in grads.values():
            g *= g.dtype.type(n)
        if waiting is None:
            waiting = grads
        else:
            for name, g in grads.items():
                waiting[name] += g
        held, tokens = held + n, tokens + n
        if 2 * held >= full or t + WINDOW >= longest:
            for g in waiting.values():
                g *= g.dtype.type(1 / held)
            optimiser.update(waiting)
            updates, waiting, held = updates + 1, None, 0
    return updates, tokens


def score(w: Weights, items: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """ln p of each document's items, state carried from its first to its last."""
    longest_first = np.argsort(-np.diff(offsets), kind="stable")
    out = np.zeros(len(longest_first))
    for at in range(0, len(longest_first), SCORE_LANES):
        order = longest_first[at : at + SCORE_LANES]
        lengths, starts = offsets[order + 1] - offsets[order], offsets[order]
        h = np.zeros((len(order), HIDDEN), np.float32, "F")
        t = 0
        while t < lengths[0]:
            states, targets, lanes = [], [], []
            for _ in range(WINDOW):
                a = int(np.searchsorted(-lengths, -t, "left"))
                if not a:
                    break
                x = items[starts[:a] + t].astype(np.int64)
                h = h[:a]
                states.append(h)
                targets.append(x)
                lanes.append(a)
                h = step(w, h, x)[0]
                t += 1
            which = np.concatenate([np.arange(a) for a in lanes])
            out[order[: lanes[0]]] += np.bincount(which, log_likelihood(w, np.ascontiguousarray(np.concatenate(states)), np.concatenate(targets)), lanes[0])
    return out


# ---- over tables ----------------------------------------------------------------


class Lexicon:
    """The fixed-size table of frequent words: their items and log10(count + 0.5)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, bucket_counts: np.ndarray, bucket_words: np.ndarray):
        rank = np.lexsort((words, -counts))
        listed = rank[: VOCABULARY]
        in_list = np.zeros(len(words), bool)
        in_list[listed] = True
        bucket = words & (BUCKETS - 1)
        tail = bucket_counts - np.bincount(bucket[listed], counts[listed], BUCKETS)
        tail_words = bucket_words - np.bincount(bucket[listed], minlength=BUCKETS)
        frequency = np.concatenate([counts[listed], np.zeros(VOCABULARY - len(listed), np.int64), tail])
        place = np.empty(len(frequency), np.int64)
        place[np.argsort(-frequency, kind="stable")] = np.arange(len(frequency))
        self.frequency = np.sort(frequency)[::-1]
        self.bucket_item = place[VOCABULARY:].astype(np.int16)
        self.bucket_norm = np.log10(tail + 0.5 * (tail_words + 1))
        item = self.bucket_item[bucket]
        item[listed] = place[: len(listed)]
        order = np.argsort(words)
        self.words, self.item, self.in_list = words[order], item[order].astype(np.int16), in_list[order]
        self.log_count = np.log10(counts[order] + 0.5)

    def _slots(self) -> np.ndarray:
        """Places in the table by a few bits of the word, the more frequent word where two
        meet; made once in each process."""
        if not hasattr(self, "_at"):
            at = np.zeros(1 << SLOT_BITS, np.int32)
            rising = np.argsort(self.log_count, kind="stable").astype(np.int32)
            at[(self.words[rising] >> 12) & ((1 << SLOT_BITS) - 1)] = rising
            self._at = at
        return self._at

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_at"}

    def look_up(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items, and places in the table or -1."""
        items = self.bucket_item[keys & (BUCKETS - 1)]
        if not len(self.words):
            return items, np.full(len(keys), -1, np.int32)
        at = self._slots()[(keys >> 12) & ((1 << SLOT_BITS) - 1)]
        rest = np.flatnonzero(self.words[at] != keys)
        place = np.minimum(np.searchsorted(self.words, keys[rest]), len(self.words) - 1)
        at[rest] = np.where(self.words[place] == keys[rest], place, -1)
        return np.where(at >= 0, self.item[at], items), at


def lexicon(counts: DataFrame) -> tuple[Lexicon, int, int, DataFrame]:
    """The lexicon, the number of tokens and of words, and the words that aren't in it.
    Words are chosen by a threshold from a histogram of counts, so no task sorts them."""
    level = F.floor(F.log2("c") * 8).cast("int")
    levels = sorted(((r.level, r.n) for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    least, room = 1 << 20, TABLE_WORDS
    for at, n in levels:
        if n > room:
            break
        least, room = at, room - n
    top = counts.where(level >= least).toArrow()
    bucket = counts.groupBy(F.col("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).collect()
    c, v = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in bucket:
        c[r.b], v[r.b] = r.c, r.v
    table = Lexicon(top.column("word").to_numpy(), top.column("c").to_numpy(), c, v)
    return table, int(c.sum()), int(v.sum()), counts.where(level < least)


def _flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in sorted(w)])


def _shaped(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for n in sorted(like):
        out[n] = flat[at : at + like[n].size].reshape(like[n].shape).astype(np.float32)
        at += like[n].size
    return out


def _sums(tokens: int, weights: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([float(tokens)]), pa.array([weights.tobytes()], pa.binary())], ["tokens", "weights"])


def _train(shared, rate: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Trains on each group from the same start; rows (group, items) come sorted by group.
    A task's groups are summed up: weights times tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        key, w, optimiser, held, size = None, None, None, [], 0
        group_tokens, tokens, total = 0, 0, np.zeros(sum(v.size for v in start.values()))

        def closed() -> None:
            """Adds the group to the task's sums."""
            nonlocal held, size, group_tokens, tokens
            if held:
                train(w, held, optimiser)
            total.__iadd__(_flat(w).astype(np.float64) * group_tokens)
            tokens, group_tokens, held, size = tokens + group_tokens, 0, [], 0

        for batch in batches:
            for group, blob in zip(batch.column("group").to_pylist(), batch.column("items"), strict=True):
                if group != key:
                    if w is not None:
                        closed()
                    key, w = group, {n: v.copy() for n, v in start.items()}
                    optimiser = Adam(w, rate)
                held.append(np.frombuffer(blob.as_buffer(), "<i2"))
                size += len(held[-1])
                group_tokens += len(held[-1])  # once, however many parts it is trained in
                if size >= HOLD_TOKENS:
                    train(w, held, optimiser)
                    held, size = [], 0
        if w is not None:
            closed()
            yield _sums(tokens, total)

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens, total = 0.0, None
    for batch in batches:
        for n, blob in zip(batch.column("tokens").to_pylist(), batch.column("weights").to_pylist(), strict=True):
            v = np.frombuffer(blob, np.float64)
            tokens, total = tokens + n, v if total is None else total + v
    if total is not None:
        yield _sums(tokens, total)


SUMS = "tokens double, weights binary"


def averaged(parts: DataFrame, like: Weights) -> Weights:
    """The mean of the partitions' weights; sums of 16 at a time until few are left."""
    n = parts.count()
    while n > 16:
        n = -(-n // 16)
        parts = cut(parts.repartition(n).mapInArrow(_sum, SUMS), "weights")
    rows = parts.collect()
    if not rows:
        return like
    return _shaped(sum(np.frombuffer(bytes(r.weights), np.float64) for r in rows) / sum(r.tokens for r in rows), like)


LOOKED_UP = "row long, doc_id long, n_tokens long, n_known long, n_rare long, base double, within double, rare array<struct<word:bigint,n:bigint>>, items binary"
SCORED = "row long, doc_id long, n_tokens long, n_known long, n_rare long, base double, score double"


def _look_up(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Items of every document; base: its known tokens' sum of log10(c + 0.5); within: the
    log10 of its words' shares of their buckets; rare: words that aren't in the table."""

    def out(lex: Lexicon, ids: list, keys: list[np.ndarray], sizes: list[np.ndarray], row: int) -> pa.RecordBatch:
        lengths = np.concatenate(sizes)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        key = np.concatenate(keys)
        docs = np.arange(len(lengths), dtype=np.int32).repeat(lengths)
        item, at = lex.look_up(key)
        known = at >= 0
        unknown = np.flatnonzero(~known)
        base = np.zeros(len(key))
        tail = ~known
        if known.any():
            base[known] = lex.log_count[at[known]]
            tail[known] = ~lex.in_list[at[known]]
        tail = np.flatnonzero(tail)
        within = np.bincount(docs[tail], base[tail] - lex.bucket_norm[key[tail] & (BUCKETS - 1)], len(lengths))
        rare, rare_doc = key[unknown], docs[unknown]
        order = np.lexsort((rare, rare_doc))
        rare, rare_doc = rare[order], rare_doc[order]
        first = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (rare_doc[1:] != rare_doc[:-1])]) if len(rare) else order
        n = np.diff(np.r_[first, len(rare)])
        bounds = np.searchsorted(rare_doc[first], np.arange(len(lengths) + 1)).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays([pa.array(rare[first]), pa.array(n.astype(np.int64))], ["word", "n"]))
        packed = pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer((2 * offsets).astype("<i4")), pa.py_buffer(item.astype("<i2"))])
        n_rare = np.bincount(docs[unknown], minlength=len(lengths)).astype(np.int64)
        counts = [lengths, lengths - n_rare, n_rare, np.bincount(docs, base, len(lengths)), within]
        arrays = [pa.array(np.arange(row, row + len(lengths))), pa.array(ids, pa.int64()), *(pa.array(c) for c in counts), listed, packed]
        return pa.RecordBatch.from_arrays(arrays, ["row", "doc_id", "n_tokens", "n_known", "n_rare", "base", "within", "rare", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = shared.value
        context = TaskContext.get()
        row = (context.partitionId() if context else 0) << 40
        ids, keys, sizes, held = [], [], [], 0
        for batch in batches:
            k, offsets = keys_of(batch.column("text").to_pylist())
            ids += batch.column("doc_id").to_pylist()
            keys.append(k)
            sizes.append(np.diff(offsets))
            held += len(k)
            if held >= HOLD_TOKENS:
                yield out(lex, ids, keys, sizes, row)
                row, ids, keys, sizes, held = row + len(ids), [], [], [], 0
        if ids:
            yield out(lex, ids, keys, sizes, row)

    return run


def _score(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def out(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.concatenate([b.column("n_tokens").to_numpy() for b in held])
        items = np.concatenate([np.frombuffer(x.as_buffer(), "<i2") for b in held for x in b.column("items")])
        found = score(shared.value, items, np.concatenate([[0], np.cumsum(sizes)])) / np.log(10)
        for b in held:
            mine, found = found[: b.num_rows], found[b.num_rows :]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(6)), pa.array(mine + b.column("within").to_numpy())], ["row", "doc_id", "n_tokens", "n_known", "n_rare", "base", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += sum(batch.column("n_tokens").to_pylist())
                if size >= SCORE_TOKENS:
                    yield from out(held)
                    held, size = [], 0
        if held:
            yield from out(held)

    return run


def trained(looked_up: DataFrame, start: Weights, tokens: int) -> Weights:
    """The weights after all rounds over the training documents."""
    sc = looked_up.sparkSession.sparkContext
    groups = max(1, round(tokens / len(ROUNDS) / GROUP_TOKENS))
    dealt = F.xxhash64("doc_id", "items")
    rows = looked_up.where(~in_class(F.col("doc_id"), 5, 1)).select("items", F.pmod(dealt, F.lit(len(ROUNDS))).alias("round"), F.pmod(F.shiftright(dealt, 8), F.lit(groups)).alias("group"), dealt.alias("place"))
    for number, rate in enumerate(ROUNDS):
        mine = rows.where(F.col("round") == number).repartition(min(groups, shuffle_width(looked_up.sparkSession)), "group")
        ordered = mine.sortWithinPartitions("group", "place", "items").select("group", "items")
        start = averaged(cut(ordered.mapInArrow(_train(sc.broadcast(start), rate), SUMS), "weights"), start)
    return start


def log_probabilities(docs: DataFrame) -> DataFrame:
    """For every row of docs: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score (unigram) and score (the model), both log10 of the text's probability."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    taught = texts.where(~in_class(F.col("doc_id"), 5, 1))
    counts = cut(taught.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("c")), "word-counts")
    lex, tokens, words, others = lexicon(counts)
    looked_up = cut(texts.mapInArrow(_look_up(sc.broadcast(lex)), LOOKED_UP), "items")
    weights = fresh_weights(lex.frequency)
    if tokens:
        weights = trained(looked_up, weights, tokens)

    slim = looked_up.select("row", "doc_id", "n_tokens", "n_known", "n_rare", "base", "within", "items")
    scored = cut(slim.mapInArrow(_score(sc.broadcast(weights)), SCORED), "scored")
    rare = looked_up.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("word"), F.col("r.n").alias("n"))
    seen = rare.join(others, "word").groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("logs"), F.sum("n").alias("seen"))
    zero = F.lit(0).cast("bigint")
    joined = scored.join(seen, "row", "left").withColumns({"logs": F.coalesce("logs", F.lit(0.0)), "seen": F.coalesce("seen", zero)})
    rest = F.col("logs") + (F.col("n_rare") - F.col("seen")) * float(np.log10(0.5))
    return joined.select(
        "doc_id",
        in_class(F.col("doc_id"), 5, 1).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.col("seen")).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + rest - F.col("n_tokens") * float(np.log10(tokens + 0.5 * (words + 1)))).alias("base_score"),
        (F.col("score") + rest).alias("score"),
    )
