"""Near-duplicate classes by a signature-coordinate inverted join.

Every distinct shingle set gets a MinHash signature of COORDINATES values.
Sets are posted under each (coordinate, value) pair. Two sets whose similarity
is at least 0.8 share MATCHES pairs at least (else with probability below
1e-9), so both hold one shared pair among all but their MATCHES - 1 most frequent
pairs. Only those rare pairs, a set's prefix, are merged; frequent lists are
skipped, and pairs that one set alone holds count for nobody. Colliding sets are
counted over the whole signature and, above MATCHES, confirmed on full sets.

Lists give no pairs of all their members. First each member of a list meets the
list's smallest id; colliding pairs are contracted to clusters. Then members of a list
that lie in different clusters meet, in cells of bounded size that tell only which clusters
they join: in chunks of about CELL members, then in chunks dealt anew, and then
every member outside its list's largest cluster meets all of its list. Any two sets that could
be linked now share a cluster, and each set goes once, with its text, to where its
cluster is confirmed on full sets: in chunks of CHUNK sets at most, then between the chunks'
components, and then every set outside its cluster's largest component meets all of its
cluster. Pairs that are connected already are skipped, as they can't change the result,
so groups whose sets are linked cost in proportion to their size. (Groups of sets that
are alike, but too little to be linked, cost the square of it.) Links between different sets are
lost only by MinHash chance; identical sets are one node from the start.

Shingles are represented by 64-bit hashes, so full sets are compared up to
collisions (below 1e-12 for a million shingles). Texts without words, null texts
and empty ones are linked with nothing. Rows without an id take no part and have
a null component. Repeated rows fall into one class; each is returned. Rows that
share an id but not the text are one node, with any one of their texts (in `classes`, whose ids
are its contract; `deduplicate` tells them apart). Other columns are ignored, empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relspark.llm import textkit as tk
from relspark.llm.common import cut, id_filter, maybe_in
from relspark.llm.components import components, relabelled

COORDINATES = 64
MATCHES = 30
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Members of a list that meet all at once, and sets that are confirmed at once.
CELL = 512
CHUNK = 256
#: Shingles of the sets that are confirmed at once, as a few sets may be very large.
CHUNK_SHINGLES = 1 << 18
_RNG = np.random.default_rng(19970625)
_FACTORS = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)

FEATURES = "doc_id long, n_shingles int, key binary, signature binary"


def shingle_sets(texts: list[str | None], width: int = 2) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; ASCII is lower-cased."""
    data, offsets = tk.join_texts(texts, lower=True)
    starts, ends = tk.word_spans(data)
    words = tk.word_hashes(data, starts, ends)
    first = tk.words_per_text(starts, offsets)
    grams = words.copy()
    for k in range(1, width):
        grams = tk.mix64(grams[: len(words) - k] * np.uint64(3) + words[k:] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) if len(words) > k else grams[:0]
    for i in range(len(texts)):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1])
        elif b > a:  # the whole sequence is the one shingle
            yield np.frombuffer(hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest(), np.uint64)
        else:
            yield words[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    out = None
    for at in range(0, len(shingles), 4096):
        low = ((shingles[at : at + 4096, None] * _FACTORS + _TERMS) >> np.uint64(32)).astype(np.uint32).min(0)
        out = low if out is None else np.minimum(out, low)
    return out


def _features(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sizes, keys, signatures = [], [], []
                for s in shingle_sets(batch.column("text").to_pylist(), width):
                    sizes.append(len(s))
                    keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    signatures.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "n_shingles", "key", "signature"])

    return run


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, token) rows: coordinate in the upper, value in the lower 32 bits."""
    high = np.arange(COORDINATES, dtype=np.int64) << 32
    for batch in batches:
        if batch.num_rows:
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES)
            reps = batch.column("rep").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(reps.repeat(COORDINATES)), pa.array((values.astype(np.int64) | high).ravel())], ["rep", "token"])


def prefixes(reps: DataFrame) -> DataFrame:
    """(token, rep, n): the postings to merge. reps: rep, n, signature."""
    posted = reps.where(100 * (F.col("n")) >= 400).select("rep", "signature").mapInArrow(_post, "rep long, token long")
    shared = posted.groupBy("token").agg(F.count(F.lit(1)).cast("int").alias("df")).where("df > 1")
    ranked = posted.join(shared, "token").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("tokens"))
    chosen = ranked.where(F.size("tokens") >= MATCHES).select("rep", F.explode(F.slice("tokens", F.lit(1), F.size("tokens") - (MATCHES - 1))["token"]).alias("token"))
    return chosen.join(reps.select("rep", "n"), "rep").select("token", "rep", "n")


def _near_size(a: str, b: str):
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b)).alias("near")


def _collisions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose signatures agree in MATCHES coordinates at least."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, COORDINATES) for c in ("a", "b"))
            yield batch.select(["x", "y"]).filter(pa.array((a == b).sum(1) >= MATCHES))


def _low_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            low = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(-1, COORDINATES).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n"), pa.array([r.tobytes() for r in low], pa.binary())], ["rep", "n", "low"])


def _merged(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root (the smallest number each number is joined with), after x and y are joined."""
    while (apart := root[x] != root[y]).any():
        x, y = root[x[apart]], root[y[apart]]
        root = root.copy()
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
    return root


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which components the colliding rows of cells join (rows come sorted by cell): y with x, the
    smallest that it is joined with, so there are fewer rows than components. Rows meet where two
    sides differ or are negative; rows that are joined already needn't."""
    held: list[pa.RecordBatch] = []

    def joined(rows: pa.Table) -> pa.RecordBatch:
        cell, n, component, side = (rows.column(c).to_numpy() for c in ("cell", "n", "component", "side"))
        low = np.frombuffer(b"".join(rows.column("low").to_pylist()), np.uint8).reshape(-1, COORDINATES)
        ends = np.searchsorted(cell, cell, "right")
        labels, number = np.unique(component, return_inverse=True)
        root = np.arange(len(labels))
        for at in range(0, len(cell), 256):
            i = np.arange(at, min(at + 256, len(cell)))
            comp = root[number]
            count = ends[i] - i - 1
            left = i.repeat(count)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            ok = (comp[left] != comp[right]) & ((side[left] != side[right]) | (side[left] < 0))
            left, right = left[ok], right[ok]
            ok = 100 * np.minimum(n[left], n[right]) >= PERCENT * np.maximum(n[left], n[right])
            left, right = left[ok], right[ok]
            ok = (low[left] == low[right]).sum(1) >= MATCHES
            root = _merged(root, comp[left[ok]], comp[right[ok]])
        moved = np.flatnonzero(root != np.arange(len(labels)))
        return pa.RecordBatch.from_arrays([pa.array(labels[root[moved]]), pa.array(labels[moved])], ["x", "y"])

    for batch in batches:
        if not batch.num_rows:
            continue
        cells = batch.column("cell").to_numpy()
        cut_at = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on
        if cut_at:
            yield joined(pa.Table.from_batches([*held, batch.slice(0, cut_at)]))
            held = []
        held.append(batch.slice(cut_at))
    if held:
        yield joined(pa.Table.from_batches(held))


def _met(rows: DataFrame, low: DataFrame) -> DataFrame:
    """Components (u, v) that collisions within cells join. rows: cell, rep, n, component, side."""
    celled = rows.join(low.select("rep", "low"), "rep").select("cell", "rep", "n", "component", "side", "low")
    return cut(celled.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells, "x long, y long").distinct().select(F.col("x").alias("u"), F.col("y").alias("v")), "near")


def merged_lists(postings: DataFrame, low: DataFrame, found: DataFrame) -> DataFrame:
    """Components found, after list members that lie in different ones have met: in chunks of
    about CELL, then in chunks dealt anew, which join those of the first, and then every member outside its
    list's largest component meets all of its list. Only collisions' components matter, so
    members that are joined already don't meet."""

    def apart(rows: DataFrame) -> DataFrame:
        """Rows of lists whose members lie in several components, with these."""
        labelled = rows.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        lists = labelled.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("token", "size")
        return labelled.join(lists, "token")

    def after(rows: DataFrame) -> DataFrame:
        more = _met(rows, low)
        return found if more.isEmpty() else components(_edges(found).union(more))

    chunks = F.ceil(F.col("size") / CELL).cast("int")
    chunked = cut(apart(postings).withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")).drop("size"), "lists")
    found = after(chunked.select(F.xxhash64("token", "chunk").alias("cell"), "rep", "n", "component", F.lit(-1).alias("side")))
    large = chunked.where("chunks > 1").select("token", "rep", "n", "chunks", "chunk")
    if large.isEmpty():
        return found

    again = F.pmod(F.xxhash64("rep", F.lit("again")), F.col("chunks"))
    found = after(apart(large).select(F.xxhash64("token", again).alias("cell"), "rep", "n", "component", F.lit(-1).alias("side")))

    # Members of one chunk have met.
    rest = cut(apart(large).drop("size"), "apart")
    parts = rest.groupBy("token", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = parts.groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("largest"))
    outside = rest.join(largest, "token").where("component <> largest")
    groups = outside.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("groups"))
    visitors = outside.join(groups, "token").withColumn("visit", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("groups")).cast("int")).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("at <> chunk")
    hosts = rest.join(groups, "token").withColumn("at", F.col("chunk")).withColumn("visit", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    sided = [rows.select(F.xxhash64("token", "at", "visit").alias("cell"), "rep", "n", "component", F.lit(side).alias("side")) for rows, side in ((visitors, 1), (hosts, 0))]
    return after(sided[0].union(sided[1]))


# ---- confirmation -----------------------------------------------------------


def links_within(sets: list[np.ndarray], labels: np.ndarray, sides: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect sets with different labels; a link between sets that earlier
    links connect isn't looked for. Sets of one side don't meet, unless it is negative."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, labels, sides = sizes[order], labels[order].copy(), sides[order]
    ends = np.cumsum(sizes)
    begins = ends - sizes
    shingles, number = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    last = np.searchsorted(sizes, sizes * 100 // PERCENT, "right")  # the largest sets that each could be linked with
    out = []
    for i in range(len(sets)):
        a, b = i + 1, int(last[i])
        if b <= a:
            continue
        meets = (labels[a:b] != labels[i]) & ((sides[a:b] != sides[i]) | (sides[i] < 0))
        if not meets.any():
            continue
        here = np.zeros(len(shingles), bool)
        here[number[begins[i] : ends[i]]] = True
        hits = np.concatenate([[0], np.cumsum(here[number[begins[a] : ends[b - 1]]])])
        common = hits[ends[a:b] - begins[a]] - hits[begins[a:b] - begins[a]]
        for j in np.flatnonzero(meets & (100 * common >= PERCENT * (sizes[i] + sizes[a:b] - common))) + a:
            if labels[j] != labels[i]:
                out.append((int(order[i]), int(order[j])))
                labels[labels == labels[j]] = labels[i]
    return out


def _confirm(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Which components the links of a cell join: each with the smallest id that it is
    joined with. Rows come sorted by cell."""

    def joined(rows: list[tuple]) -> pa.RecordBatch:
        sets = [x for at in range(0, len(rows), 64) for x in shingle_sets([r[3] for r in rows[at : at + 64]], width)]
        labels = [r[1] for r in rows]
        root = {x: x for x in labels}
        for i, j in links_within(sets, np.array(labels), np.array([r[2] for r in rows])):
            a, b = sorted((root[labels[i]], root[labels[j]]))
            root = {x: a if r == b else r for x, r in root.items()}
        moved = [(x, r) for x, r in root.items() if x != r]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in moved], pa.int64()), pa.array([r for _, r in moved], pa.int64())], ["node", "component"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            for cell, *row in zip(*(batch.column(c).to_pylist() for c in ("cell", "rep", "component", "side", "text")), strict=True):
                if rows and cell != key:
                    yield joined(rows)
                    rows = []
                key = cell
                rows.append(row)
        if rows:
            yield joined(rows)

    return run


def _edges(found: DataFrame) -> DataFrame:
    return found.select(F.col("node").alias("u"), F.col("component").alias("v"))


def _parts() -> Column:
    """How many chunks rows with n shingles each make."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum(F.col("n").cast("bigint")) / CHUNK_SHINGLES)).cast("int")


def confirmed(texts: DataFrame, sizes: DataFrame, clusters: DataFrame, width: int) -> DataFrame:
    """Components by confirmed links within clusters, as components() gives them.
    sizes: rep, n."""
    members = clusters.union(clusters.select(F.col("component").alias("node"), "component")).distinct()
    sized = members.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(sizes, "rep")
    placed = sized.join(sized.groupBy("cluster").agg(_parts().alias("chunks")), "cluster")
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    bitmap = id_filter(members.select(F.col("node").alias("id")))
    # Most texts need no shuffle: they belong to no cluster. Repeated rows of an id go once.
    some = maybe_in(texts, bitmap).join(placed, F.col("doc_id") == F.col("rep")).dropDuplicates(["rep"])
    held = cut(some.select("rep", "n", "cluster", "chunks", "chunk", "text"), "clustered")

    def linked(rows: DataFrame) -> DataFrame:
        return cut(rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_confirm(width), "node long, component long"), "links")

    # A set is in one chunk, so what a cell finds needs no merging with others.
    found = linked(held.select(F.xxhash64("cluster", "chunk").alias("cell"), "rep", F.col("rep").alias("component"), F.lit(-1).alias("side"), "text"))
    large_ones = held.where("chunks > 1")
    if large_ones.isEmpty():
        return found

    def apart() -> DataFrame:
        """Members of large clusters that have more than one component left."""
        large = large_ones.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        open_ones = large.groupBy("cluster").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("cluster")
        return large.join(open_ones, "cluster", "left_semi")

    # Between the chunks' components: the smallest set id of each stands for it.
    heads = apart().where("rep = component")
    counts = heads.groupBy("cluster").agg(_parts().alias("parts"))
    dealt = heads.join(counts, "cluster").select(F.xxhash64("cluster", F.pmod(F.xxhash64("rep"), F.col("parts"))).alias("cell"), "rep", "component", F.lit(-1).alias("side"), "text")
    found = cut(relabelled(found, linked(dealt)), "confirmed")

    # Sets outside their cluster's largest component visit all its chunks, in groups of
    # bounded size; the largest component's sets needn't meet each other.
    rest = cut(apart(), "apart")
    parts = rest.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("size"))
    largest = parts.groupBy("cluster").agg(F.max_by("component", F.struct("size", "component")).alias("largest"))
    outside = rest.join(largest, "cluster").where("component <> largest")
    groups = outside.groupBy("cluster").agg(_parts().alias("groups"))
    visitors = outside.join(groups, "cluster").select(
        "cluster",
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("at"),
        F.pmod(F.xxhash64("rep"), F.col("groups")).cast("int").alias("visit"),
        "rep",
        "component",
        F.lit(1).alias("side"),
        "text",
    )
    hosts = rest.join(groups, "cluster").select("cluster", F.col("chunk").alias("at"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("visit"), "rep", "component", F.lit(0).alias("side"), "text")
    last = linked(visitors.union(hosts).select(F.xxhash64("cluster", "at", "visit").alias("cell"), "rep", "component", "side", "text"))
    # Here a component may be in several cells.
    return found if last.isEmpty() else relabelled(found, components(_edges(last)))


def classes(docs: DataFrame, width: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    features = cut(texts.mapInArrow(_features(width), FEATURES), "shingles")
    reps = cut(
        features.where("doc_id is not null and n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("signature").alias("signature")),
        "sets",
    )
    postings = cut(prefixes(reps), "prefixes")
    low = cut(reps.join(postings.select("rep").distinct(), "rep", "left_semi").mapInArrow(_low_bytes, "rep long, n int, low binary"), "low-bytes")
    hubs = postings.groupBy("token").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    stars = postings.join(hubs, "token").where("rep <> hub.rep").where(_near_size("n", "hub.n")).select(F.col("hub.rep").alias("x"), F.col("rep").alias("y")).distinct()
    signed = stars.join(low.select(F.col("rep").alias("x"), F.col("low").alias("a")), "x").join(low.select(F.col("rep").alias("y"), F.col("low").alias("b")), "y")
    near = cut(signed.select("x", "y", "a", "b").mapInArrow(_collisions, "x long, y long").select(F.col("x").alias("u"), F.col("y").alias("v")), "near")
    clusters = merged_lists(postings, low, components(near))
    found = confirmed(texts, low.select("rep", "n"), clusters, width)

    label = reps.select("key", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    return features.select("doc_id", "n_shingles", "key").join(label, "key", "left").select(
        "doc_id",
        F.col("n_shingles").cast("bigint").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(False)).alias("kept"),
    )


#: Further texts of an id get numbers from here on.
FURTHER = 1 << 62


def _told_apart(docs: DataFrame) -> DataFrame:
    """docs as _doc, with doc_id and text; of an id that stands for several texts, all but one
    text (that of the smallest hash) get numbers of their own, by id and text. Only rows whose id may be such
    a one are shuffled."""
    text = F.col("text").cast("string")
    mark = F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), mark.alias("_mark"))
    marks = cut(packed.where("doc_id is not null").select("doc_id", "_mark").distinct(), "marks")
    several = marks.groupBy("doc_id").agg(F.min("_mark").alias("first"), F.count(F.lit(1)).alias("texts")).where("texts > 1").select("doc_id", "first")
    number = F.xxhash64("doc_id", "_mark").bitwiseAND(F.lit(FURTHER - 1)) + F.lit(FURTHER)
    further = cut(marks.join(several, "doc_id").where(F.col("_mark") != F.col("first")).select("doc_id", "_mark", number.alias("_number")), "further")
    if further.isEmpty():
        return packed.drop("_mark")
    clashing = id_filter(further.select(F.col("doc_id").alias("id")))
    # A row without an id is hashed like any other, so it is in one of the two parts.
    numbered = maybe_in(packed, clashing).join(further, ["doc_id", "_mark"], "left").select("_doc", F.coalesce("_number", "doc_id").alias("doc_id"), "text")
    return maybe_in(packed, clashing, member=False).drop("_mark").union(numbered)


def deduplicate(docs: DataFrame, width: int = 5) -> DataFrame:
    """One row of docs for each class: the smallest id's. Same columns. Shingles are of
    five words, which fewer changed words tell apart than the two of `classes`. Rows without an
    id are linked with nothing and stay. Of rows that share id and text, one stays; different texts of one
    id are documents of their own, and all but one of them count as larger than any id. Only documents that
    go, or whose id is repeated, are shuffled with their texts."""
    packed = _told_apart(docs)
    found = cut(classes(packed.select("doc_id", "text"), width), "classes")
    packed = packed.select("_doc", "doc_id")
    gone = found.where("doc_id is not null and not kept").select("doc_id").distinct()
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    touched = cut(gone.withColumn("_gone", F.lit(True)).unionByName(repeated.withColumn("_gone", F.lit(False))).groupBy(F.col("doc_id").alias("_id")).agg(F.max("_gone").alias("_gone")), "touched")
    bitmap = id_filter(touched.select(F.col("_id").alias("id")))
    untouched = maybe_in(packed, bitmap, member=False)
    joined = maybe_in(packed, bitmap).join(touched, F.col("doc_id") == F.col("_id"), "left").where("_gone is null or not _gone")
    once = joined.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.md5(F.col("_doc").cast("string").cast("binary"))))).where("_gone is null or _n = 1")
    return untouched.select("_doc").union(once.select("_doc")).select(*(F.col("_doc").getField(c).alias(c) for c in docs.columns))
