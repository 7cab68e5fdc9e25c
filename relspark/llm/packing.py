"""Packing of documents into fixed windows by non-negative least squares.

Document lengths are counted in a histogram of coarse bins; shallow combinations
of bins that fill a window are the columns of a non-negative least squares
problem whose right side is the histogram. The rounded-down solution says how
often each combination is used. What it leaves, short documents above all, is joined
in the same way to bundles that fill 8, 16, 32, ... tokens, up to the window; so the
combinations stay shallow whatever the lengths. What is left then is packed greedily,
cut wherever a gap ends. Gaps that binning leaves are filled by pieces of the residual
too, and, where it doesn't suffice, by those of as few planned sequences as do, so
only the end of a partition is short; it is laid out in powers of two, which need no
padding.

Blocks of bounded token counts are solved one after the other in each input
partition: no shuffle, no global order, bounded memory, and a lost task is
recomputed alone with the same outcome. A block's unfilled tail is carried into
the next block.

Nulls: a null text is an empty document, its only id being the end id. Repeated
rows are packed once each. Empty tables give no pieces. Other columns are
ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WINDOW = 2048
END_ID = 1
#: Bins of the length histogram, and pieces that a combination has at most.
BINS = 64
DEPTH = 3
#: Tokens that are packed at a time.
BLOCK_TOKENS = 1 << 21
VOCABULARY = "byte_bpe_50k.json"

# ---- non-negative least squares -------------------------------------------


def combinations(bins: int = BINS, depth: int = DEPTH) -> np.ndarray:
    """Multisets of up to `depth` bin sizes (1..bins) whose sum is exactly bins,
    as columns that count the pieces of each size."""
    found: list[list[int]] = []

    def extend(chosen: list[int], left: int, least: int) -> None:
        if left == 0:
            found.append(chosen)
        elif len(chosen) < depth:
            for size in range(least, left + 1):
                if size == left or (left - size >= size and len(chosen) + 1 < depth):
                    extend([*chosen, size], left - size, size)

    extend([], bins, 1)
    a = np.zeros((bins, len(found)))
    for j, sizes in enumerate(found):
        for s in sizes:
            a[s - 1, j] += 1
    return a


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Minimises |a x - b| over x >= 0 by the active-set method of Lawson and
    Hanson; each round solves one small least-squares problem."""
    x = np.zeros(a.shape[1])
    active = np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        if active.sum() >= a.shape[0] or gradient.max(initial=-np.inf) <= tolerance:
            break
        active[int(gradient.argmax())] = True
        while True:
            s = np.zeros_like(x)
            s[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            bad = active & (s <= 0)
            if not bad.any():
                break
            step = (x[bad] / np.maximum(x[bad] - s[bad], 1e-300)).min()
            x += step * (s - x)
            active &= x > tolerance
            x[~active] = 0
        x = s
    return x


_TABLES: dict[int, np.ndarray] = {}


def planned(lengths: np.ndarray, window: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Which pieces fill a window together, by one solution for the histogram of their
    lengths, and which are left. A piece counts as the next whole bin, so that a group's
    lengths never exceed the window."""
    bins = min(BINS, window)
    if bins not in _TABLES:
        _TABLES[bins] = combinations(bins)
    a = _TABLES[bins]
    fit = np.flatnonzero(lengths <= window)
    bin_of = -(-lengths[fit] * bins // window) - 1
    left = np.bincount(bin_of, minlength=bins)
    counts = np.floor(nnls(a, left.astype(float)) + 1e-6).astype(np.int64) if len(fit) else np.zeros(a.shape[1], np.int64)
    queues = np.split(fit[np.argsort(bin_of, kind="stable")], np.cumsum(left)[:-1])
    groups: list[np.ndarray] = []
    for j in np.argsort(-counts, kind="stable"):
        if counts[j] <= 0:
            break
        need = a[:, j].astype(np.int64)
        n = int(min(counts[j], *(left[need > 0] // need[need > 0])))  # rounding never overdraws
        if n <= 0:
            continue
        members = []
        for k in np.flatnonzero(need):
            take = n * need[k]
            members.append(queues[k][left[k] - take : left[k]].reshape(n, need[k]))
            left[k] -= take
        groups += list(np.concatenate(members, 1))
    gone = np.zeros(len(lengths), bool)
    if groups:
        gone[np.concatenate(groups)] = True
    return groups, np.flatnonzero(~gone)


def plan(lengths: np.ndarray, window: int = WINDOW) -> tuple[list[list[int]], list[int]]:
    """Documents (each within a window) that make a sequence together, as combinations
    say, and those left. What the first solution leaves is joined to bundles that fill
    ever larger fractions of the window, each by a solution of its own; a bundle is then a
    piece like any other. So shallow combinations serve short documents too."""
    groups, left = planned(lengths, window)
    sequences = [g.tolist() for g in groups]
    pieces, sizes = [[int(d)] for d in left], lengths[left]
    level = 8
    while level <= window and len(pieces) > 1:
        groups, left = planned(sizes, level)
        bundles = [[d for i in g for d in pieces[i]] for g in groups]
        if level == window:
            sequences += bundles
            bundles = []
        sums = [int(sizes[g].sum()) for g in groups][: len(bundles)]
        sizes = np.array([*sums, *sizes[left]], np.int64)
        pieces = [*bundles, *(pieces[i] for i in left)]
        level *= 2
    return sequences, [d for p in pieces for d in p]


def _poured(rows: list[list[tuple[int, int, int]]], pieces: list[tuple[int, int, int]], window: int) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Rows filled up with pieces from the end of the list, cut wherever a gap ends: full
    rows, rows that stay short, pieces left."""
    full, at = [], 0
    while at < len(rows):
        row = rows[at]
        gap = window - sum(p[2] for p in row)
        while gap and pieces:
            d, start, length = pieces.pop()
            take = min(gap, length)
            row.append((d, start, take))
            gap -= take
            if length > take:
                pieces.append((d, start + take, length - take))
        if gap:
            break
        full.append(row)
        at += 1
    return full, rows[at:], pieces


def pack_lengths(lengths: np.ndarray, window: int = WINDOW) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Packs documents of given lengths. Returns full sequences, each a list of
    pieces (document, start, length), and the pieces that fill no window."""
    full: list[list[tuple[int, int, int]]] = []
    rest = lengths % window
    for d in np.flatnonzero(lengths >= window).tolist():
        full += [[(d, s * window, window)] for s in range(int(lengths[d]) // window)]
    docs = np.flatnonzero(rest)
    sequences, left = plan(rest[docs], window)

    def piece(i: int) -> tuple[int, int, int]:
        d = int(docs[i])
        return d, int(lengths[d] - rest[d]), int(rest[d])

    # The residual, longest last, fills the gaps that binning left.
    begun = [[piece(i) for i in s] for s in sequences]
    pieces = [piece(i) for i in sorted(left, key=lambda i: rest[docs[i]], reverse=True)]
    done, begun, pieces = _poured(begun, pieces, window)
    full += done
    # Where it doesn't suffice, as few planned sequences as do are unmade for the others' gaps.
    missing = sum(window - sum(p[2] for p in r) for r in begun)
    while begun and missing > sum(p[2] for p in pieces):
        row = begun.pop()
        missing -= window - sum(p[2] for p in row)
        pieces += row
    done, begun, pieces = _poured(begun, pieces, window)
    full += done
    # Whole windows of what is left then.
    empty = [[] for _ in range(sum(p[2] for p in pieces) // window)]
    done, _, pieces = _poured(empty, pieces, window)
    return full + done, [*(p for r in begun for p in r), *pieces]


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Pieces below a window in all, cut into sequences whose lengths are powers
    of two, largest first, so that none is padded."""
    total = sum(p[2] for p in pieces)
    out, queue = [], pieces[::-1]
    for bit in range(total.bit_length() - 1, -1, -1):
        if total >> bit & 1:
            row, gap = [], 1 << bit
            while gap:
                d, start, length = queue.pop()
                take = min(gap, length)
                row.append((d, start, take))
                gap -= take
                if length > take:
                    queue.append((d, start + take, length - take))
            out.append(row)
    return out


# ---- tokens ---------------------------------------------------------------

_ENCODERS: dict[tuple[str, bool], Callable[[str], np.ndarray]] = {}
#: Letters on which both libraries' Unicode tables agree: up to Latin Extended-B.
_BEYOND = re.compile("[^\x00-ɏ]")


def encoder(vocabulary: str = VOCABULARY, special_as_text: bool = False) -> Callable[[str], np.ndarray]:
    """The ids of a text by the tokenizers library: encode(text, add_special_tokens=False).
    A special token's own string in a text gives its id, unless special_as_text. Where the
    same vocabulary lies beside it as ranks, plain texts take the faster library, which
    gives the same ids; texts with such strings or rarer characters, or that it refuses,
    always take the first."""
    if (vocabulary, special_as_text) in _ENCODERS:
        return _ENCODERS[vocabulary, special_as_text]
    exact = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    exact.encode_special_tokens = special_as_text
    added = [t.content for t in exact.get_added_tokens_decoder().values()]
    apart = re.compile("|".join([_BEYOND.pattern, *map(re.escape, added)]))

    def slow(text: str) -> np.ndarray:
        return np.asarray(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    ranks_file = public_tokenizers.path(vocabulary.replace(".json", ".tiktoken"))
    if not os.path.exists(ranks_file):
        _ENCODERS[vocabulary, special_as_text] = slow
        return slow
    with open(ranks_file) as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(str.split, lines)}
    quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def fast(text: str) -> np.ndarray:
        if apart.search(text):
            return slow(text)
        try:
            return np.asarray(quick.encode_ordinary(text), np.uint32)
        except BaseException as e:  # the library panics on runs it can't match
            if isinstance(e, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            return slow(text)

    _ENCODERS[vocabulary, special_as_text] = fast
    return fast


# ---- over tables ----------------------------------------------------------

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
_TYPES = [pa.int64()] * 8
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


class _Packer:
    """Packs one partition block by block."""

    def __init__(self, first_id: int):
        self.next_id = first_id
        self.ids: list[np.ndarray] = []
        self.keys: list[tuple[int | None, int, int]] = []  # doc_id, ids before this part, ids of the document
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray, before: int, whole: int) -> None:
        self.ids.append(ids)
        self.keys.append((doc_id, before, whole))
        self.held += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch:
        full, short = pack_lengths(np.array([len(x) for x in self.ids], np.int64))
        if last:
            full, short = full + powers_of_two(short), []
        rows = []
        for pieces in full:
            at, total = 0, sum(p[2] for p in pieces)
            for d, start, length in pieces:
                key, before, whole = self.keys[d]
                rows.append((key, before + start, length, zlib.crc32(self.ids[d][start : start + length].astype("<u4", copy=False).tobytes()), whole, self.next_id, at, total))
                at += length
            self.next_id += 1
        kept = [(self.keys[d], self.ids[d][s : s + n], s) for d, s, n in short]
        self.ids, self.keys, self.held = [], [], 0
        for (key, before, whole), ids, s in kept:
            self.add(key, ids, before + s, whole)
        columns = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _pack_partition(vocabulary: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = np.array([END_ID], np.uint32)
        context = TaskContext.get()
        packer = _Packer((context.partitionId() if context else 0) << 40)
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                value = text.as_py()
                ids = np.concatenate([encode(value), end]) if value else end
                packer.add(key, ids, 0, len(ids))
                if packer.held >= BLOCK_TOKENS:
                    yield packer.flush(last=False)
        if packer.ids:
            yield packer.flush(last=True)

    return run


def pack(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents; see the module for nulls and repeated rows.
    Sequence ids are unique: input partition and number in it."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_pack_partition(vocabulary), PIECES)
