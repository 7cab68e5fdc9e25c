"""Mixing of sources to target weights by temperature.

With p_i the share of source i in all tokens, the weights are p_i^a normalised. The
exponent a is bisected: the largest a in [0, 1] whose weights reach a target entropy,
then, if some source would be repeated more often than allowed, the smallest a above
it that keeps to the limit. Weights become token budgets, and budgets become copies
of documents: whole passes over a source, and for the rest of its budget the head of
a permutation of its documents.

The permutation is two-level. Documents fall into blocks by hash, blocks are permuted
by hash, and only sums per block are ordered within a source: a source that holds a
third of all rows is BLOCK_ROWS times smaller there. Within the one block where a
budget ends, its documents are permuted. Everything is made of DataFrame functions.

Sources may be many, hosts say: their totals stay a table, and only sums over all of
them, at the exponents that a pass tries, come to the driver. Null sources are a source of their own; null texts have no
tokens, as have empty ones: such documents are emitted once per whole pass. Repeated
rows are documents of their own. Empty tables give empty results. In `mix`, all
columns pass through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from relspark.llm.common import cut, words_of

BLOCK_ROWS = 1024
#: The exponent is found to 1 / GRID, which takes so many bisections.
GRID = 1 << 20
BISECTIONS = 20
#: Parts that a pass over the sources cuts a bracket into: five bisections.
PARTS = 32
PPM = 1_000_000
#: Share of the largest possible entropy, and passes over a source, to aim for.
TARGET_ENTROPY = 0.97
MAX_REPEATS = 4.0


def _hash(*parts: Column) -> Column:
    """52 bits of MD5 of the parts' text."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("bigint")


def measured(docs: DataFrame) -> DataFrame:
    """docs with _m: source key, tokens (words), and a hash of id and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumn(
        "_m",
        F.struct(
            F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("source"),
            F.size(words_of(text)).cast("bigint").alias("tokens"),
            _hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text.cast("binary"))).alias("hash"),
        ),
    )


def _exponent(live: DataFrame, every: int, target_entropy: float, allowed: float, cover: bool) -> Row:
    """The exponent, in 1 / GRID, and of the weights that it gives their sum and the
    smallest per token. live: p, tokens; every: how many sources.

    Both tests hold on one side of some exponent only. Five bisections of both brackets
    go together: sums at all points where they could look are made in one pass over the
    sources, and a row for each point comes to the driver."""
    wanted = target_entropy * math.log(every) - 1e-9
    e = F.col("e") / F.lit(float(GRID))
    power, rate = F.pow("p", e), F.pow("p", e - 1.0)
    z = F.sum("w")
    repeats = F.max("r") / F.min("r") if cover else F.max("r") / z
    tests = [(F.log(z) - F.sum(F.col("w") * F.log("w")) / z >= wanted).alias("even"), (repeats <= allowed).alias("fits")]
    seen: dict[int, Row] = {}
    flat, fit = (0, GRID), (0, GRID)  # even at the lower end of one, fitting at the upper end of the other
    while True:
        points = sorted({low + (high - low) * k // PARTS for low, high in (flat, fit) for k in range(PARTS + 1)} - set(seen))
        if not points:
            break
        at = live.select("p", "tokens", F.explode(F.array(*map(F.lit, points))).alias("e")).select("e", "tokens", power.alias("w"), rate.alias("r"))
        found = at.groupBy("e").agg(z.alias("z"), F.min(F.col("w") / F.col("tokens")).alias("least"), *tests)
        seen |= {x.e: x for x in found.collect()}
        flat = _bracket(flat, seen, lambda x: x.even)
        fit = _bracket(fit, seen, lambda x: not x.fits)
    even = GRID if seen[GRID].even else flat[0]
    return seen[max(even, 0 if seen[0].fits else fit[1])]


def _bracket(bracket: tuple[int, int], seen: dict[int, Row], below: Callable[[Row], bool]) -> tuple[int, int]:
    """The part of a bracket in which a test that holds at its lower end fails first."""
    inside = sorted(e for e in seen if bracket[0] < e < bracket[1])
    low, high = bracket
    for e in inside:
        if not below(seen[e]):
            return low, e
        low = e
    return low, high


def weights(totals: DataFrame, target_entropy: float, max_repeats: float, cover: bool) -> DataFrame:
    """source, rows, tokens, exponent (in 1 / GRID), weight and budget (tokens).

    totals: source, rows, tokens. With cover, the budget is scaled until every source
    is passed once at least, and made of weights that aren't rounded; else it is the
    weight in millionths of the number of tokens that there are."""
    live = totals.where("tokens > 0")
    whole, every = live.agg(F.sum("tokens"), F.count(F.lit(1))).first()
    tokens = F.col("tokens").cast("double")
    if every:
        p = tokens / F.lit(float(whole))
        found = _exponent(live.select(p.alias("p"), "tokens"), every, target_entropy, max_repeats + 1e-9, cover)
        e, z, least = found.e, found.z, found.least
    else:  # documents without words alone: no weights, all is passed once
        p, whole, e, z, least = F.lit(1.0), 0, GRID, 1.0, 1.0
    power = F.pow(p, F.lit(e) / F.lit(float(GRID)))
    # Weights to a millionth, so that engines agree on them; budgets are whole tokens.
    ppm = F.when(F.col("tokens") > 0, F.round(power / F.lit(z) * PPM)).otherwise(0).cast("bigint")
    out = totals.select("source", "rows", "tokens", F.lit(e).cast("bigint").alias("exponent"), ppm.alias("weight_ppm"))
    if not cover:
        return out.withColumn("budget", F.floor(F.col("weight_ppm") * F.lit(whole).cast("bigint") / PPM).cast("bigint"))
    # Passes relative to the source that is passed least, which is passed once. The
    # bisection allows for rounding; whole tokens beyond the limit it must not give.
    relative = F.when(F.col("tokens") > 0, power / F.col("tokens") / F.lit(least)).otherwise(1.0)
    passes = F.least(relative, F.lit(float(max_repeats)))
    return out.withColumn("budget", F.greatest(F.col("tokens"), F.floor(passes * F.col("tokens") + 1e-6)).cast("bigint"))


def limits(rows: DataFrame, target_entropy: float, max_repeats: float, cover: bool) -> DataFrame:
    """A row per source that says what is emitted: passes over all of it; and, of the
    permutation, the block where the budget ends and the last document taken there.

    rows: doc_id, _m."""
    totals = rows.groupBy(F.col("_m.source").alias("source")).agg(F.count(F.lit(1)).alias("rows"), F.sum("_m.tokens").alias("tokens"))
    found = cut(weights(cut(totals, "mix-totals"), target_entropy, max_repeats, cover), "mix-weights")
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(1).cast("bigint")
    sources = found.select("source", "weight_ppm", "budget", passes.alias("passes"), (F.col("budget") - passes * F.col("tokens")).alias("rest"), F.ceil(F.col("rows") / BLOCK_ROWS).cast("bigint").alias("blocks"))

    placed = rows.select("doc_id", F.col("_m.source").alias("source"), F.col("_m.tokens").alias("tokens"), F.col("_m.hash").alias("hash")).join(sources.select("source", "rest", "blocks"), "source").withColumn("place", _place("source", "hash", "blocks"))
    blocks = placed.groupBy("source", "place", "rest").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("place"))
    ends = (
        blocks.withColumn("upto", upto)
        .where(F.col("upto") > F.col("rest"))
        .groupBy("source")
        .agg(F.min(F.struct("place", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("room"))).alias("end"))
        .select("source", F.col("end.place").alias("place"), F.col("end.room").alias("room"))
    )
    # Only the documents of the blocks where budgets end are sorted.
    taken = F.sum("tokens").over(Window.partitionBy("source", "place").orderBy("hash", "doc_id"))
    last = placed.where("tokens > 0").join(ends, ["source", "place"]).withColumn("taken", taken).where("taken <= room").groupBy("source").agg(F.max(F.struct("hash", "doc_id")).alias("last"))
    return cut(sources.join(ends.select("source", F.col("place").alias("end")), "source", "left").join(last, "source", "left"), "mix-limits")


def _place(source: str, number: str, blocks: str) -> Column:
    """Where a document's block stands in its source's permutation."""
    block = F.pmod(F.col(number), F.col(blocks))
    return F.struct(_hash(F.col(source), block.cast("string")).alias("at"), block.alias("block"))


def counted(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs (doc_id, _m and any others) with _l, their source's limits, the place of
    their block and copies. The limits, a row per source, are joined to documents;
    documents are neither sorted nor shuffled for it while sources are few."""
    one = found.select(F.col("source").alias("_s"), F.struct("weight_ppm", "budget", "passes", "blocks", "end", "last").alias("_l"))
    joined = docs.join(one, F.col("_m.source") == F.col("_s")).drop("_s").withColumns({"_h": F.col("_m.hash"), "_key": F.col("_m.source"), "_n": F.col("_l.blocks")})
    placed = joined.withColumn("_place", _place("_key", "_h", "_n")).drop("_h", "_key", "_n")
    inside = (F.col("_place") == F.col("_l.end")) & (F.struct(F.col("_m.hash").alias("hash"), F.col("doc_id").cast("bigint").alias("doc_id")) <= F.col("_l.last"))
    more = F.coalesce((F.col("_place") < F.col("_l.end")) | inside, F.lit(False)) & (F.col("_m.tokens") > 0)
    return placed.withColumn("copies", F.col("_l.passes") + more.cast("bigint"))


def _slim(docs: DataFrame) -> DataFrame:
    """Ids, sources, tokens and hashes, without texts."""
    return cut(measured(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text")).drop("text"), "mix-rows")


def report(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = MAX_REPEATS) -> DataFrame:
    """For every row of docs: doc_id, source, n_tokens, weight_ppm, budget, block, copies."""
    rows = _slim(docs)
    return counted(rows, limits(rows, target_entropy, max_repeats, cover=False)).select(
        "doc_id", "source", F.col("_m.tokens").alias("n_tokens"), F.col("_l.weight_ppm").alias("weight_ppm"), F.col("_l.budget").alias("budget"), F.col("_place.block").alias("block"), "copies"
    )


def mix(docs: DataFrame, target_entropy: float = TARGET_ENTROPY, max_repeats: float = 2.0, cover: bool = True) -> DataFrame:
    """The mixture: each row of docs as often as its copies say, same columns. Texts are
    read twice, and never shuffled while sources are few."""
    found = limits(_slim(docs), target_entropy, max_repeats, cover)
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), "doc_id", "source", "text")
    emitted = counted(measured(packed).drop("text", "source"), found).where("copies > 0")
    return emitted.select("_doc", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("_copy")).select(*(F.col("_doc").getField(c).alias(c) for c in docs.columns))
