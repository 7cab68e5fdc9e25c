"""Removal of repeated passages with a suffix array of limited depth.

A byte is removed if a string of LENGTH bytes that covers it also starts earlier:
in a document with a smaller id, or earlier in the same one.

1. Windows of LENGTH bytes are dealt by content: each belongs to the smallest
   hashed k-gram within it, its anchor, so equal windows have equal anchors. The
   consecutive windows of one anchor are a run. Runs are counted by anchor; an
   anchor with one run is done. Of equal runs, all but the first are repeats, which
   every task settles for its own runs before it sends the first ones on.
2. The distinct runs of an anchor that are left are cut from the texts and meet in
   blocks of bounded size. A block's Burrows-Wheeler transform is expanded breadth
   first: common prefixes of length 0 split the suffixes into intervals, and each
   boundary of value v yields, one step back through the transform, boundaries of
   value v + 1. It stops at LENGTH: suffixes that are still together share that
   many bytes. Every member of a class but its first is a repeat.
3. Covered bytes are united per document.

Anchors that are frequent in a sample of SAMPLE_DOCUMENTS are dealt by the runs' bytes
as well, so that their runs don't meet in one task; which ones these are changes only
where the work is done. Anchors with more than HOT_RUNS distinct runs are split further,
by whole windows, whose minima are summed up before the shuffle.

Nulls: a null text is empty; rows without an id take no part and lose nothing.
Rows that share an id are one document: neither repeats the other at the same
start. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relspark.llm import textkit as tk
from relspark.llm.common import cut, id_filter, maybe_in, shuffle_width

LENGTH = 100
GRAM = 30
#: Bytes of text that are looked at together, and positions that fit an anchor's low bits.
BATCH_BYTES = 1 << 20
_POSITION = (1 << 26) - 1
#: Runs that a task holds before it hands them on.
HOLD_RUNS = 1 << 18
BLOCK_BYTES = 1 << 18
HOT_RUNS = 20_000
#: Documents from which frequent anchors are guessed, and occurrences that make one.
SAMPLE_DOCUMENTS = 8_000
FREQUENT = 16
U64 = np.uint64

REPEATS = "kind int, doc_id long, start long, n int, anchor long"
#: Kinds of rows: repeated windows; the first of a distinct run, of an ordinary anchor, of
#: one with very many, and of one that was dealt by bytes too.
SPAN, RUN, HOT, SPLIT = 0, 1, 2, 3


# ---- runs ------------------------------------------------------------------


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor position: text index, start in the text,
    number of windows, anchor, hash of the bytes that the windows cover."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),) * 2
    total = np.zeros(n + 1, U64)
    np.cumsum(tk.BYTE_VALUES[data] * tk.powers(tk.BASE, n), out=total[1:])
    inverse = tk.powers(tk.BASE_INV, n + 1)
    h = tk.mix64((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    low = (h & ~U64(_POSITION)) | np.arange(len(h), dtype=U64)
    at = (sliding_min(low, length - gram + 1) & U64(_POSITION)).astype(np.int64)
    text = np.arange(len(offsets) - 1).repeat(np.maximum(np.diff(offsets) - length, 0))
    before = np.concatenate([[0], np.cumsum(np.maximum(np.diff(offsets) - length, 0))])
    starts = np.arange(len(text)) - before[text] + offsets[text]  # windows within texts; each text ends in a line feed of ours
    at = at[starts]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])]) if len(at) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(at)])
    a = starts[first]
    cover = tk.mix64((total[a + count + length - 1] - total[a]) * inverse[a] + count.astype(U64))
    return text[first], a - offsets[text[first]], count, h[at[first]], cover


def _pieces(ids: list[int], texts: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """Ids, bytes and offsets in the text of pieces, in groups of bounded size; long
    texts are cut into pieces that overlap by LENGTH - 1 bytes."""
    group: tuple[list[int], list[bytes], list[int]] = ([], [], [])
    size = 0
    for key, text in zip(ids, texts, strict=True):
        for at in range(0, max(1, len(text) - LENGTH + 1), BATCH_BYTES):
            piece = text[at : at + BATCH_BYTES + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            for values, v in zip(group, (key, piece, at), strict=True):
                values.append(v)
            size += len(piece)
            if size >= BATCH_BYTES:
                yield np.array(group[0], np.int64), group[1], np.array(group[2], np.int64)
                group, size = ([], [], []), 0
    if group[0]:
        yield np.array(group[0], np.int64), group[1], np.array(group[2], np.int64)


_RUN = np.dtype([("anchor", "<u8"), ("cover", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("n", "u1")])


_LOW48 = U64((1 << 48) - 1)


def _packed(a: np.ndarray) -> bytes:
    """Column by column, which compresses well; hashes are cut to 48 bits."""
    six = [np.ascontiguousarray(a[c]).view(np.uint8).reshape(-1, 8)[:, :6].tobytes() for c in ("anchor", "cover")]
    return b"".join([*six, *(np.ascontiguousarray(a[c]).tobytes() for c in ("doc", "start", "n"))])


def _unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // 25
    out = np.zeros(n, _RUN)
    at = 0
    for c in ("anchor", "cover"):
        eight = np.zeros((n, 8), np.uint8)
        eight[:, :6] = np.frombuffer(blob, np.uint8, 6 * n, at).reshape(n, 6)
        out[c] = eight.view("<u8").ravel()
        at += 6 * n
    for c, kind in (("doc", "<i8"), ("start", "<u4"), ("n", "u1")):
        out[c] = np.frombuffer(blob, kind, n, at)
        at += np.dtype(kind).itemsize * n
    return out


def _leaders(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs in order of anchor, bytes and place; which are the first of their anchor
    and bytes; which are at another place than that first one."""
    a = a[np.lexsort((a["start"], a["doc"], a["cover"], a["anchor"]))]
    new = np.r_[True, (a["anchor"][1:] != a["anchor"][:-1]) | (a["cover"][1:] != a["cover"][:-1])][: len(a)]
    leader = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
    return a, new, (a["doc"] != a["doc"][leader]) | (a["start"] != a["start"][leader])


def _tasks_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The runs of a task's texts, HOLD_RUNS or so at a time, hashes cut to 48 bits."""
    held, size = [], 0
    for batch in batches:
        texts = [t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        for ids, pieces, at in _pieces(batch.column("doc_id").to_pylist(), texts):
            text, start, count, anchor, cover = runs(*tk.join_texts(pieces))
            a = np.empty(len(text), _RUN)
            a["anchor"], a["cover"], a["doc"], a["start"], a["n"] = anchor & _LOW48, cover & _LOW48, ids[text], start + at[text], count
            held.append(a)
            size += len(a)
            if size >= HOLD_RUNS:
                yield np.concatenate(held)
                held, size = [], 0
    if size:
        yield np.concatenate(held)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for a in _tasks_runs(batches):
        anchor, n = np.unique(a["anchor"], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(anchor.astype(np.int64)), pa.array(n.astype(np.int64))], ["anchor", "n"])


def _deal(buckets: int, frequent: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blobs of runs by bucket. Buckets from `buckets` on are those of frequent anchors;
    bucket -1 - b holds repeats that this task has settled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a in _tasks_runs(batches):
            a, new, later = _leaders(a)
            bucket = (a["anchor"] % U64(buckets)).astype(np.int64)
            often = frequent[np.minimum(np.searchsorted(frequent, a["anchor"]), len(frequent) - 1)] == a["anchor"] if len(frequent) else np.zeros(len(a), bool)
            bucket[often] = buckets + (tk.mix64(a["anchor"][often] ^ (a["cover"][often] << U64(13))) % U64(buckets)).astype(np.int64)
            bucket[~new] = -1 - a["doc"][~new] % buckets
            keep = new | later
            a, bucket = a[keep], bucket[keep]
            order = np.argsort(bucket, kind="stable")
            a, bucket = a[order], bucket[order].astype(np.int32)
            first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array([_packed(x) for x in np.split(a, first[1:])], pa.binary())], ["bucket", "runs"])

    return run


def _rows(a: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
    columns = [kind.astype(np.int32), a["doc"].copy(), a["start"].astype(np.int64), a["n"].astype(np.int32), a["anchor"].astype(np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["kind", "doc_id", "start", "n", "anchor"])


def repeated_runs(a: np.ndarray, hot: int, split: bool = False) -> pa.RecordBatch:
    """Of the runs of one bucket: later copies of equal runs, as spans; and the first
    of each distinct run, where an anchor has several. With split, an anchor's other
    runs may be in other buckets."""
    if not split:
        _, which, counts = np.unique(a["anchor"], return_inverse=True, return_counts=True)
        a = a[counts[which] > 1]
    a, new, later = _leaders(a)
    group = np.cumsum(np.r_[True, a["anchor"][1:] != a["anchor"][:-1]][: len(a)]) - 1
    distinct = np.bincount(group, new).astype(np.int64)[group] if len(a) else group
    kind = np.where(new, SPLIT if split else np.where(distinct > hot, HOT, RUN), SPAN)
    keep = np.where(new, split | (distinct > 1), later)
    return _rows(a[keep], kind[keep])


def _count(buckets: int, hot: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def done(bucket: int, held: list[np.ndarray]) -> pa.RecordBatch:
        a = np.concatenate(held)
        return _rows(a, np.full(len(a), SPAN)) if bucket < 0 else repeated_runs(a, hot, split=bucket >= buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, size = None, [], 0
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("runs"), strict=True):
                if held and (bucket != key or (bucket < 0 and size >= HOLD_RUNS)):
                    yield done(key, held)
                    held, size = [], 0
                key = bucket
                held.append(_unpacked(blob.as_py()))
                size += len(held[-1])
        if held:
            yield done(key, held)

    return run


# ---- Burrows-Wheeler transform ---------------------------------------------


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of text (values below 512; the last is its only smallest) sorted by
    their first `depth` values at least, by doubling from packed 7-value prefixes."""
    n = len(text)
    padded = np.zeros(n + 7, U64)
    padded[:n] = text
    key = np.zeros(n, U64)
    for j in range(7):
        key = key << U64(9) | padded[j : j + n]
    reach = 7
    while True:
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
        if reach >= depth or rank[order[-1]] == n - 1:
            return order
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - reach)] = rank[reach:] + 1
        key = rank.astype(U64) << U64(32) | ahead.astype(U64)
        reach *= 2


def common_prefix_classes(text: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For suffixes in order, the number of the class of those that share their first
    `length` values. Boundaries (value v: the neighbours share v values) are derived by
    increasing value from the Burrows-Wheeler transform: if equal symbols stand at i' < i
    in it with none between them, and the smallest value of a boundary in (i', i] is v,
    then the suffixes that they lead back to are neighbours that share v + 1 values."""
    n = len(text)
    bwt = text[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    back = np.empty(n, np.int64)  # where the suffix that begins one earlier stands
    back[by_symbol] = np.arange(n)
    symbols = bwt[by_symbol]
    same = np.r_[False, symbols[1:] == symbols[:-1]]
    previous, following = np.full(n, -1), np.full(n, n)  # the nearest equal symbols
    previous[by_symbol[same]] = by_symbol[np.flatnonzero(same) - 1]
    following[by_symbol[np.flatnonzero(same) - 1]] = by_symbol[same]

    boundary = np.zeros(n, bool)
    boundary[0] = True
    interval = np.zeros(n, np.int32)  # number of the interval that holds a position
    low, high = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    high[0], used = n - 1, 1
    fresh = np.flatnonzero(~same)[1:]  # value 0: where the first symbol changes
    for _ in range(length):
        if not len(fresh):
            break
        boundary[fresh] = True
        # Each interval with fresh boundaries falls into parts; all but the largest are walked.
        owner = interval[fresh]
        head = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        tail = np.r_[head[1:], len(fresh)] - 1
        extra = np.arange(len(head))
        part_low = np.insert(fresh, head, low[owner[head]])
        part_high = np.insert(fresh - 1, tail + 1, high[owner[head]])
        part_owner = np.insert(owner, head, owner[head])
        size = part_high - part_low + 1
        begin = head + extra
        most = np.maximum.reduceat(size, begin)
        largest = np.zeros(len(size), bool)
        group = np.repeat(extra, np.diff(np.r_[begin, len(size)]))
        candidate = np.flatnonzero(size == most[group])
        largest[candidate[np.r_[True, group[candidate][1:] != group[candidate][:-1]]]] = True
        old_low, old_high = low[part_owner], high[part_owner]
        kept = np.flatnonzero(largest)
        low[part_owner[kept]], high[part_owner[kept]] = part_low[kept], part_high[kept]
        walk = np.flatnonzero(~largest)
        names = np.arange(used, used + len(walk))
        low[names], high[names] = part_low[walk], part_high[walk]
        used += len(walk)
        lengths = size[walk]
        part = walk.repeat(lengths)
        position = part_low[part] + np.arange(len(part)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        interval[position] = names.repeat(lengths).astype(np.int32)
        # Equal symbols in an earlier part lead back to a boundary at the walked one; equal
        # symbols in a later part to one at the later.
        p, f = previous[position], following[position]
        reached = np.concatenate([back[position[(p >= old_low[part]) & (p < part_low[part])]], back[f[(f <= old_high[part]) & (f > part_high[part])]]])
        fresh = np.unique(reached[~boundary[reached]])
    return np.cumsum(boundary) - 1


def repeated_windows(snippets: list[bytes], docs: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (document, start, number of windows) of the windows of snippets that also
    start earlier in the given ones."""
    sizes = np.array([len(s) for s in snippets])
    joined = np.frombuffer(b"\0".join(snippets) + b"\0", np.uint8).astype(np.uint16) + 2
    ends = np.cumsum(sizes + 1) - 1
    joined[ends] = 1  # ends a snippet; no window holds it
    text = np.r_[joined, np.uint16(0)]
    order = suffix_order(text, length)
    classes = np.empty(len(text), np.int64)
    classes[order] = common_prefix_classes(text, order, length)
    windows = np.maximum(sizes - length + 1, 0)
    which = np.arange(len(snippets)).repeat(windows)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    label = classes[(ends - sizes)[which] + offset]
    begin = starts[which] + offset
    rank = np.lexsort((begin, docs[which], label))
    ordered = label[rank]
    lead = np.maximum.accumulate(np.where(np.r_[True, ordered[1:] != ordered[:-1]], np.arange(len(rank)), 0))
    first = rank[lead]
    repeat = np.zeros(len(which), bool)
    repeat[rank] = (docs[which][rank] != docs[which][first]) | (begin[rank] != begin[first])
    at = np.flatnonzero(repeat)
    head = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(which[at]) != 0)]) if len(at) else at
    count = np.diff(np.r_[head, len(at)])
    return docs[which[at[head]]], begin[at[head]], count


# ---- over tables ------------------------------------------------------------


def _cut_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[tuple] = []
        for key, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            out += [(w["anchor"], key, w["start"], raw[w["start"] : w["start"] + w["n"] + LENGTH - 1]) for w in wanted]
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["anchor", "doc_id", "start", "snippet"])


def _cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            at = [w["start"] + i for w in wanted for i in range(w["n"])]
            digests = [hashlib.blake2b(raw[s : s + LENGTH], digest_size=16).digest() for s in at]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([key] * len(at), pa.int64()), pa.array(at, pa.int64())], ["window", "doc_id", "start"])


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole anchors are gathered to blocks; rows come sorted by anchor."""
    keys: list[int] = []
    docs: list[int] = []
    starts: list[int] = []
    snippets: list[bytes] = []
    size = 0

    def flush() -> pa.RecordBatch:
        doc, start, n = repeated_windows(snippets, np.array(docs, np.int64), np.array(starts, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int32())], ["doc_id", "start", "n"])

    for batch in batches:
        for anchor, doc, start, snippet in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if size >= BLOCK_BYTES and anchor != keys[-1]:
                yield flush()
                keys, docs, starts, snippets, size = [], [], [], [], 0
            keys.append(anchor)
            docs.append(doc)
            starts.append(start)
            snippets.append(snippet)
            size += len(snippet) + 1
    if snippets:
        yield flush()


def _classified(repeats: DataFrame, hot: int) -> DataFrame:
    """Split runs become ordinary or hot ones by the number of their anchor's; a single
    one is no repeat. The counts are as many as there are frequent anchors."""
    counts = F.broadcast(repeats.where(F.col("kind") == SPLIT).groupBy("anchor").agg(F.count(F.lit(1)).alias("runs")).withColumn("kind", F.lit(SPLIT)))
    joined = repeats.join(counts, ["anchor", "kind"], "left").where((F.col("kind") != SPLIT) | (F.col("runs") > 1))
    kind = F.when(F.col("kind") != SPLIT, F.col("kind")).when(F.col("runs") > hot, HOT).otherwise(RUN)
    return joined.select(kind.alias("kind"), "doc_id", "start", "n", "anchor")


def repeated_spans(docs: DataFrame, hot: int = HOT_RUNS) -> DataFrame:
    """doc_id, start, n: n windows from start on that also start earlier."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= LENGTH))
    buckets = 8 * shuffle_width(spark)
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, docs.count()))
    often = texts.sample(share, 1).mapInArrow(_anchors, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    frequent = np.sort(often.select("anchor").toArrow().column("anchor").to_numpy()).astype(U64)  # SAMPLE_DOCUMENTS bounds it
    dealt = texts.mapInArrow(_deal(buckets, frequent), "bucket int, runs binary")
    found_runs = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_count(buckets, hot), REPEATS)
    repeats = cut(found_runs, "repeats")
    spans = repeats.where(F.col("kind") == SPAN).select("doc_id", "start", "n")
    firsts = repeats.where(F.col("kind") != SPAN)
    if len(frequent):
        firsts = cut(_classified(firsts, hot), "runs")

    def wanted(kind: int) -> DataFrame:
        asked = firsts.where(F.col("kind") == kind)
        per_doc = asked.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "anchor")).alias("wanted"))
        some = maybe_in(texts, id_filter(asked.select(F.col("doc_id").alias("id"))))
        return some.join(per_doc, "doc_id").select("doc_id", "text", "wanted")

    snippets = wanted(RUN).mapInArrow(_cut_runs, "anchor long, doc_id long, start long, snippet binary").distinct()
    found = snippets.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_expand, "doc_id long, start long, n int")
    spans = spans.union(found)
    if not firsts.where(F.col("kind") == HOT).isEmpty():
        windows = cut(wanted(HOT).mapInArrow(_cut_windows, "window binary, doc_id long, start long"), "hot-windows")
        first = windows.groupBy("window").agg(F.min(F.struct("doc_id", "start")).alias("first"))
        later = windows.join(first, "window").where(F.struct("doc_id", "start") > F.col("first"))
        spans = spans.union(later.select("doc_id", "start", F.lit(1).alias("n")))
    return spans


def covered(spans: list[dict], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal runs of bytes (begin, end) that the windows of the spans cover."""
    out: list[tuple[int, int]] = []
    for begin, end in sorted((s["start"], s["start"] + s["n"] - 1 + length) for s in spans):
        if out and begin <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((begin, end))
    return out


def kept_bytes(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for begin, end in gone:
        parts.append(raw[at:begin])
        at = end
    return b"".join([*parts, raw[at:]])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, spans in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            gone = covered(spans)
            rows.append((key, len(raw), sum(e - b for b, e in gone), len(gone), hashlib.sha256(kept_bytes(raw, gone)).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 4, pa.string()), strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def measured(docs: DataFrame) -> DataFrame:
    """What removal does to each document: doc_id, n_bytes, n_removed, n_spans,
    kept_sha256. Documents that lose nothing are never shuffled."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"))
    per_doc = cut(repeated_spans(docs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "spans")
    bitmap = id_filter(per_doc.select(F.col("doc_id").alias("id")))
    touched = maybe_in(rows, bitmap).join(per_doc, "doc_id", "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:bigint,n:int>>")))
    changed = touched.mapInArrow(_measure, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    zero = F.lit(0).cast("bigint")
    same = maybe_in(rows, bitmap, member=False).select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return changed.union(same)


def whole_characters(raw: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans shrunk to the UTF-8 characters that lie in them entirely."""
    out = []
    for begin, end in gone:
        while begin < end and raw[begin] & 0xC0 == 0x80:
            begin += 1
        while end > begin and end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        if begin < end:
            out.append((begin, end))
    return out


def _trim(columns: list[str], text: str, n_chars: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, keep = [], []
            for value, spans in zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist(), strict=True):
                raw = (value or "").encode("utf-8", "surrogatepass")
                gone = whole_characters(raw, covered(spans or []))
                new.append(kept_bytes(raw, gone).decode("utf-8", "surrogatepass") if gone else value)
                keep.append(not gone or bool(new[-1].strip(" \t\n\x0b\x0c\r")))
            doc = batch.column("_doc")
            fields = {c: doc.field(i) for i, c in enumerate(columns)}
            fields[text] = pa.array(new, fields[text].type)
            if n_chars:
                fields[n_chars] = pa.array([None if t is None else len(t) for t in new]).cast(fields[n_chars].type)
            yield pa.RecordBatch.from_arrays([fields[c] for c in columns], columns).filter(pa.array(keep))

    return run


def remove(docs: DataFrame) -> DataFrame:
    """docs without the repeated passages: same columns, text and n_chars (where there
    is one) made anew. Characters are removed whole. A document of which no word is left
    goes."""
    columns = docs.columns
    per_doc = cut(repeated_spans(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("start", "n")).alias("_spans")), "spans")
    bitmap = id_filter(per_doc.select(F.col("_id").alias("id")))
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_doc"), F.col("doc_id").cast("bigint").alias("doc_id"))
    untouched = maybe_in(packed, bitmap, member=False).select(*(F.col("_doc").getField(c).alias(c) for c in columns))
    touched = maybe_in(packed, bitmap).join(per_doc, F.col("doc_id") == F.col("_id"), "left").select("_doc", F.col("_doc.text").cast("string").alias("_text"), "_spans")
    return untouched.union(touched.mapInArrow(_trim(columns, "text", "n_chars" if "n_chars" in columns else None), docs.schema))
