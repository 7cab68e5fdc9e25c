"""Exact top-k search by inner product with a pivot-distance index.

Inner products become distances by one more coordinate: with M the largest norm,
x' = (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) give
|q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest x' has the largest product.

Index: every vector is keyed by its nearest pivot and its distance to it; sorted
by that key, runs of BLOCK_ROWS vectors are blocks, each an annulus around a pivot. Queries
are packed to chunks in the same order.

Search: first each chunk meets the annuli that its own rows lie in, so that every query
has a lower bound of its k-th score. The triangle inequality then says between which
distances from each pivot an annulus must lie to hold a better vector; only blocks and
chunks that meet so, found on the numbers alone, are sent to one another, in cells of
bounded size. There a query expands annuli by growing lower bound |d(q', p) - d(x', p)| and
stops when no unvisited one can reach its k-th score.

Pivots are at most PIVOTS rows, of an id each, the only sample; every row is indexed and the
result is exact. Pivots are rows themselves: their scores bound each query's k-th score
from the start.

Vectors that are null or hold null or non-finite components take no part, nor do
rows without an id; vectors of other lengths than the query's aren't compared.
Repeated rows are candidates each; a repeated query is answered once. Ties go to
the smaller vec_id. An empty table gives an empty result. Other columns are
ignored. Scores are exact while they fit into 64 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from relspark.llm.common import cut, hashed_share, shuffle_width

PIVOTS = 48
BLOCK_ROWS = 256
CHUNK_QUERIES = 256
#: Blocks and query chunks that meet in one cell.
CELL_BLOCKS = 64
CELL_CHUNKS = 8
#: Blocks whose numbers are compared in one task with those of chunks.
JOIN_BLOCKS = 4096
SCALE = 256.0

INDEXED = "dim int, pivot int, distance double, vec_id long, v binary"
BLOCKS = "block long, dim int, pivot int, low double, high double, ids binary, vectors binary, floors binary"
#: The score that a query is known to reach k times; this, where nothing is known.
NO_FLOOR = -(1 << 63)


def quantised(embeddings: DataFrame, scale: float = SCALE) -> DataFrame:
    """vec_id and floor(scale * x) of each component, of the usable vectors."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(~bad).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("v"))


def _norms(v: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", v, v)


def distances(v: np.ndarray, pivots: np.ndarray, largest: float) -> np.ndarray:
    """Distances of augmented vectors to augmented pivots."""
    n, m = _norms(v), _norms(pivots)
    lift_v, lift_p = np.sqrt(np.maximum(largest - n, 0)), np.sqrt(np.maximum(largest - m, 0))
    squared = n[:, None] + m[None] - 2 * (v @ pivots.T) + (lift_v[:, None] - lift_p[None]) ** 2
    return np.sqrt(np.maximum(squared, 0))


def query_distances(q: np.ndarray, pivots: np.ndarray, largest: float) -> np.ndarray:
    """Distances of q' = (q, 0) to augmented pivots: |q|^2 + M^2 - 2 q.p."""
    return np.sqrt(np.maximum(_norms(q)[:, None] + largest - 2 * (q @ pivots.T), 0))


def _index(pivots: np.ndarray, largest: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v")
            lengths = np.diff(lists.offsets.to_numpy())
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                v = np.stack([flat[at[r] : at[r] + dim] for r in rows]) if dim else np.zeros((len(rows), 0), np.int64)
                if dim and dim == pivots.shape[1]:
                    d = distances(v.astype(float), pivots, largest)
                    near = d.argmin(1)
                    distance = d[np.arange(len(d)), near]
                else:
                    near, distance = np.full(len(rows), -1), np.zeros(len(rows))
                packed = pa.array([x.tobytes() for x in v.astype("<i8")], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), dim, np.int32)), pa.array(near.astype(np.int32)), pa.array(distance), pa.array(ids[rows]), packed], ["dim", "pivot", "distance", "vec_id", "v"])

    return run


def _blocks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Packs sorted index rows, with floors, into blocks of one dimension and pivot. Blocks
    are numbered in their order within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number, key, rows = (context.partitionId() if context else 0) << 40, None, []

        def packed() -> pa.RecordBatch:
            order = sorted(range(len(rows)), key=lambda i: rows[i][1])  # ties go to the smaller id
            ids, floors = (np.array([rows[i][j] for i in order], "<i8").tobytes() for j in (1, 3))
            values = [[number], [key[0]], [key[1]], [rows[0][0]], [rows[-1][0]], [ids], [b"".join(rows[i][2] for i in order)], [floors]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for dim, pivot, distance, vec_id, v, floor in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if rows and (key != (dim, pivot) or len(rows) == size):
                    yield packed()
                    number, rows = number + 1, []
                key = (dim, pivot)
                rows.append((distance, vec_id, v, floor))
        if rows:
            yield packed()

    return run


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["vectors"], "<i8").reshape(len(ids), row["dim"])


def _floors(row: dict) -> np.ndarray:
    known = np.frombuffer(row["floors"], "<i8")
    return np.where(known == NO_FLOOR, -np.inf, known.astype(float))


def pivot_floors(query_ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, k: int, pivot_ids: np.ndarray | None) -> np.ndarray:
    """What pivots, being rows, say that each query's k-th score is at least."""
    if pivot_ids is not None and len(pivots) >= k:
        scores = q @ pivots.T
        scores[query_ids[:, None] == pivot_ids[None]] = -np.inf  # no answers of its own
        return np.sort(scores, 1)[:, -k]
    if pivot_ids is None and len(pivots) > k:  # the query itself may be one of them
        return np.sort(q @ pivots.T, 1)[:, -k - 1]
    return np.full(len(q), -np.inf)


def _slack(largest: float) -> float:
    return 0.5 + 1e-9 * largest


def _reaches(pivots: np.ndarray, pivot_ids: np.ndarray, largest: float, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Between which distances from each pivot a chunk's annuli lie."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                ids, vectors = _unpack(row)
                if not row["dim"] or row["dim"] != pivots.shape[1]:
                    out.append((row["block"], row["dim"], -1, -np.inf, np.inf))
                    continue
                q = vectors.astype(float)
                floor = np.maximum(pivot_floors(ids, q, pivots, k, pivot_ids), _floors(row)) - _slack(largest)
                reach = query_distances(q, pivots, largest)
                gap = np.sqrt(np.maximum(_norms(q) + largest - 2 * floor, 0))[:, None]
                low, high = (reach - gap).min(0), (reach + gap).max(0)
                out += [(row["block"], row["dim"], p, low[p], high[p]) for p in range(len(pivots))]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["chunk", "dim", "pivot", "least", "most"])

    return run


def search_cell(blocks: list[dict], queries: tuple[np.ndarray, np.ndarray], pivots: np.ndarray, largest: float, k: int, pivot_ids: np.ndarray | None = None, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (query_id, vec_id, score) of each query among the blocks, found
    by expanding annuli; fewer where pivots' scores, or the floors that are known,
    already rule rows out. Without pivot_ids, pivots are of ids that differ."""
    query_ids, q = queries
    exact = largest < float(1 << 53)  # no partial sum then leaves the exact range of doubles
    kind = np.float64 if exact else np.int64
    work = [(b, *_unpack(b)) for b in blocks]
    qf = q.astype(float)
    floor_score = np.full(len(q), -np.inf) if floors is None else floors
    bounds = np.full((len(q), len(work)), -np.inf)  # upper bounds of scores
    if q.shape[1] and q.shape[1] == pivots.shape[1]:
        reach = query_distances(qf, pivots, largest)
        floor_score = np.maximum(floor_score, pivot_floors(query_ids, qf, pivots, k, pivot_ids))
        for j, (b, _, _) in enumerate(work):
            gap = np.maximum(np.maximum(b["low"] - reach[:, b["pivot"]], reach[:, b["pivot"]] - b["high"]), 0)
            bounds[:, j] = (_norms(qf) + largest - gap**2) / 2
    else:
        bounds[:] = np.inf
    slack = _slack(largest)
    lowest = -np.inf if exact else np.iinfo(np.int64).min + 1  # can be negated
    best_score = np.full((len(q), k), lowest, kind)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
    filled = np.zeros(len(q), bool)

    def visit(j: int, mine: np.ndarray) -> None:
        _, ids, vectors = work[j]
        scores = q[mine].astype(kind) @ vectors.T.astype(kind)
        own = ids[None] == query_ids[mine, None]
        take = min(k, len(ids))
        scores[own] = lowest
        kth = np.partition(scores, len(ids) - take, 1)[:, len(ids) - take]
        # What doesn't reach the k-th score so far is no answer.
        least = np.where(filled[mine], np.maximum(kth, best_score[mine, k - 1]), kth)
        row, col = np.nonzero((scores >= least[:, None]) & ~own)
        # Blocks are sorted by id, so the first k of equal scores are the right ones.
        rank = np.lexsort((ids[col], -scores[row, col], row))
        row, col = row[rank], col[rank]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col, place = row[place < k], col[place < k], place[place < k]
        changed, at = np.unique(row, return_inverse=True)
        mine = mine[changed]
        new_score = np.full((len(mine), k), lowest, kind)
        new_id = np.full((len(mine), k), np.iinfo(np.int64).max, np.int64)
        new_score[at, place], new_id[at, place] = scores[row, col], ids[col]
        both_score, both_id = np.concatenate([best_score[mine], new_score], 1), np.concatenate([best_id[mine], new_id], 1)
        rank = np.lexsort((both_id, -both_score), axis=1)[:, :k]
        best_score[mine], best_id[mine] = np.take_along_axis(both_score, rank, 1), np.take_along_axis(both_id, rank, 1)
        filled[mine] = best_id[mine, k - 1] != np.iinfo(np.int64).max

    # Each query its own best annulus, then all queries together the others, best first.
    best = bounds.argmax(1)
    for j in np.unique(best):
        visit(j, np.flatnonzero((best == j) & (bounds[:, j] >= floor_score - slack)))
    for j in np.argsort(-bounds.max(0), kind="stable"):
        threshold = np.maximum(floor_score, np.where(filled, best_score[:, k - 1], -np.inf)) - slack
        if bounds[:, j].max() < threshold.min():
            break
        mine = np.flatnonzero((bounds[:, j] >= threshold) & (best != j))
        if len(mine):
            visit(j, mine)
    row, col = np.nonzero(best_id != np.iinfo(np.int64).max)
    return query_ids[row], best_id[row, col], best_score[row, col].astype(np.int64)


def _cells(pivots: np.ndarray, pivot_ids: np.ndarray, largest: float, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(blocks: pa.Table, chunks: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        have = blocks.to_pylist()
        for chunk in chunks.to_pylist():
            same = [b for b in have if b["dim"] == chunk["dim"]]
            if same:
                found.append(search_cell(same, _unpack(chunk), pivots, largest, k, pivot_ids, _floors(chunk)))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return run


def search(vectors: DataFrame, is_query, k: int, pivots: int = PIVOTS) -> DataFrame:
    """For each row for which is_query holds, its k best other rows.

    vectors: vec_id long, v array of long. Returns query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    few = vectors.where(hashed_share(F.col("vec_id"), 8 * pivots / max(1, vectors.count())))
    # One row of an id, so that pivots other than a query are as many of its candidates.
    sample = few.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    dim = max(({len(r.v) for r in sample}), key=lambda d: (sum(len(r.v) == d for r in sample), d), default=0)
    chosen, ids = [r.v for r in sample if len(r.v) == dim], np.array([r.vec_id for r in sample if len(r.v) == dim], np.int64)
    points = np.array(chosen, float).reshape(len(chosen), dim)
    largest = float(vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))).first()[0] or 0)
    index = cut(vectors.mapInArrow(_index(points, largest), INDEXED), "pivot-index")

    width = shuffle_width(spark)
    sort = ["dim", "pivot", "distance", "vec_id"]

    def packed(rows: DataFrame, size: int, label: str) -> DataFrame:
        ordered = rows.repartitionByRange(width, *sort).sortWithinPartitions(*sort).select(*sort, "v", "floor")
        return cut(ordered.mapInArrow(_blocks(size), BLOCKS), label)

    blocks = packed(index.withColumn("floor", F.lit(NO_FLOOR).cast("bigint")), BLOCK_ROWS, "pivot-blocks")
    asked = index.where(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min(F.struct("dim", "pivot", "distance", "v")).alias("x")).select("x.dim", "x.pivot", "x.distance", "vec_id", "x.v")
    asked = cut(asked, "pivot-queries")
    down = max(1, -(-asked.count() // (CHUNK_QUERIES * CELL_CHUNKS)))
    annuli = blocks.select("block", "dim", "pivot", "low", "high")

    def met(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
        """The best of each query among the blocks that its chunk is paired with; blocks and
        chunks go only to cells that hold a pair."""
        g, h = F.floor(F.col("block") / CELL_BLOCKS), F.pmod(F.xxhash64("chunk"), F.lit(down))
        placed = pairs.select("block", "chunk", g.alias("g"), h.alias("h"))
        left = blocks.drop("floors").join(placed.select("block", "g", "h").distinct(), "block")
        right = chunks.withColumnRenamed("block", "chunk").join(placed.select("chunk", F.col("g").alias("cg"), F.col("h").alias("ch")).distinct(), "chunk")
        partial = left.groupBy("g", "h").cogroup(right.groupBy("cg", "ch")).applyInArrow(_cells(points, ids, largest, k), "query_id long, vec_id long, score long")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return partial.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    # First the annuli that a chunk's own rows lie in: as many pairs as blocks and chunks.
    chunks = packed(asked.withColumn("floor", F.lit(NO_FLOOR).cast("bigint")), CHUNK_QUERIES, "pivot-chunks")
    own = chunks.select(F.col("block").alias("chunk"), "dim", "pivot", F.col("low").alias("least"), F.col("high").alias("most"))
    near = met(own.join(annuli, ["dim", "pivot"]).where("low <= most and high >= least"), chunks)
    floors = near.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))

    # Then all that the floors don't rule out.
    chunks = packed(asked.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NO_FLOOR).cast("bigint"))), CHUNK_QUERIES, "pivot-chunks")
    pairs = cut(surviving(annuli, chunks.mapInArrow(_reaches(points, ids, largest, k), "chunk long, dim int, pivot int, least double, most double")), "pivot-pairs")
    return met(pairs, chunks).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def surviving(annuli: DataFrame, reaches: DataFrame) -> DataFrame:
    """Pairs (block, chunk) that the triangle inequality leaves. Only numbers meet; those of
    a pivot with many blocks are dealt to several tasks."""
    parts = max(1, -(-annuli.count() // JOIN_BLOCKS))
    dealt = annuli.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
    spread = reaches.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    return dealt.join(spread, ["dim", "pivot", "part"]).where("low <= most and high >= least").select("block", "chunk")
