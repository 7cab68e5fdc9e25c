"""Quality rules: robust multivariate outliers by language and source.

Counts of each text (words, symbols, repeated lines and words) are transformed to
a vector of whole numbers, hundredths of square roots of rates, and tallied: a cell
per distinct vector and group. On the cells, minimum-covariance-determinant estimates are
made per group of language and source. STARTS estimates (medians with the least deviations
that are believed; medians with median absolute deviations; mean and covariance of all) each
go through concentration steps: the H documents with the smallest distances give mean and
covariance anew, until no group changes, MOST_STEPS at most. Of a group's results that with
the least determinant is kept. Its covariance is scaled by CONSISTENCY, which makes that of
the H nearest of a normal distribution the whole one's, and documents beyond the chi-square
quantile QUANTILE (one in a million of a normal distribution) are rejected. FLOORS, standard
deviations whose squares are added to the variances, keep a statistic that hardly varies in
a group from rejecting ordinary documents; words in repeated windows, which the base rules
bound already, can't reject by themselves. Groups below LEAST_ROWS documents use the
estimate over all documents.

No group's cells meet in one task: the H nearest are found on tallies of distances by BINS
bins to a doubling, and only cells of the bin in which the H-th lies are ordered.

Sums are of whole numbers, so results don't depend on the order of rows. All is made
of DataFrame and SQL functions. Word windows are compared by 64-bit hashes.

Nulls: a null text has no words and fails the base rules; null languages and sources
are groups of their own; a null id is carried along. Repeated rows count each and are
each judged. Empty tables give empty results. In `reject`, all other columns pass
through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from relspark.llm.common import cut, words_of

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
#: Vector: mean word length, symbols per word, repeated lines per line, repeated words per word.
DIM = 4
FLOORS = (20, 7, 12, 15)
SHARE_NUMERATOR, SHARE_DENOMINATOR = 3, 4
STARTS = 3
MOST_STEPS = 12
LEAST_ROWS = 40
#: 0.75 / P(X6 <= q) with q the quantile of X4 at 0.75; the quantile of X4 at 1 - 1e-6. Xn is
#: chi-square with n degrees of freedom.
CONSISTENCY = 1.4864156071332657
QUANTILE = 33.37684158171984
CUTOFF = QUANTILE * CONSISTENCY
#: A normal distribution's standard deviation over its median absolute deviation.
MAD_SCALE = 1.4826
#: Distances are compared in whole parts of this, and tallied by this many bins to a doubling.
DISTANCE_PARTS = 1024
BINS = 32
#: Tasks, at least, that the cells of a large group are dealt to.
SALTS = 16


# ---- counts ------------------------------------------------------------------


def counted(docs: DataFrame) -> DataFrame:
    """docs with a column _q of counts, in one narrow pass over the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    blank = lambda c: F.length(F.translate(c, BLANKS, ""))
    lines = F.filter(F.split(text, "\n"), lambda line: blank(line) > 0)
    have = [F.col(f"`{c}`") for c in docs.columns]
    hashed = docs.select(*have, F.transform(words_of(text), lambda w: F.xxhash64(w)).alias("_qw"), lines.alias("_ql"))
    n = F.size("_qw")
    w = lambda i, k: F.get("_qw", i + k)
    grams = F.when(n >= WINDOW_WORDS, F.transform(F.sequence(F.lit(0), n - WINDOW_WORDS), lambda i: F.xxhash64(*(w(i, k) for k in range(WINDOW_WORDS))))).otherwise(F.array().cast("array<bigint>"))
    windowed = hashed.select(
        *have,
        n.cast("bigint").alias("_qn"),
        F.size("_ql").cast("bigint").alias("_qlines"),
        (F.size("_ql") - F.size(F.array_distinct("_ql"))).cast("bigint").alias("_qdup"),
        grams.alias("_qg"),
    )
    # Most texts repeat no window; only the others are sorted.
    repeats = F.size(F.array_distinct("_qg")) < F.size("_qg")
    nothing = F.array().cast("array<struct<g:bigint,i:int>>")
    ordered = windowed.select(*have, "_qn", "_qlines", "_qdup", F.when(repeats, F.array_sort(F.transform("_qg", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(nothing).alias("_qs"))
    g = lambda i: F.get("_qs", i)["g"]
    again = F.filter("_qs", lambda x, i: F.coalesce(g(i - 1) == x["g"], F.lit(False)) | F.coalesce(g(i + 1) == x["g"], F.lit(False)))
    placed = ordered.select(*have, "_qn", "_qlines", "_qdup", F.array_sort(F.transform(again, lambda x: x["i"])).alias("_qp"))
    p = F.col("_qp")
    covered = F.when(F.size(p) == 0, F.lit(0)).otherwise(
        F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda a, i: a + F.when(i == 0, WINDOW_WORDS).otherwise(F.least(F.lit(WINDOW_WORDS), F.get(p, i) - F.get(p, i - 1))))
    )
    return placed.select(
        *have,
        F.struct(
            F.col("_qn").alias("n_words"),
            blank(text).cast("bigint").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            F.col("_qdup").alias("n_dup_lines"),
            covered.cast("bigint").alias("n_repeat_words"),
            F.col("_qlines").alias("n_lines"),
        ).alias("_q"),
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < LEAST_WORDS) | (100 * n_repeat_words > MOST_REPEATED_PERCENT * n_words)


def vectors(rows: DataFrame) -> DataFrame:
    """Rows with _q, plus group keys _lang and _source and the vector x1..x4."""
    d = lambda c: F.col(f"_q.{c}").cast("double")
    rate = lambda a, b: F.floor(100 * F.sqrt(d(a) / F.greatest(d(b), F.lit(1.0)))).cast("bigint")
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    return rows.withColumns(
        {
            "_lang": key("lang"),
            "_source": key("source"),
            "x1": rate("word_chars", "n_words"),
            "x2": rate("n_symbols", "n_words"),
            "x3": rate("n_dup_lines", "n_lines"),
            "x4": rate("n_repeat_words", "n_words"),
        }
    )


# ---- minimum covariance determinant ------------------------------------------

_X = [f"x{i}" for i in range(1, DIM + 1)]
_PAIRS = [(i, j) for i in range(DIM) for j in range(i + 1)]
_GROUP = ["_lang", "_source"]
_ESTIMATE = [*(f"m{i}" for i in range(DIM)), *(f"l{i}{j}" for i, j in _PAIRS)]


def with_distance(rows: DataFrame, e) -> DataFrame:
    """Rows with _d2, the squared Mahalanobis distance of x1..x4; e gives an estimate's
    columns: means m and the covariance's Cholesky factor l."""
    for i in range(DIM):
        y = F.col(_X[i]).cast("double") - e(f"m{i}")
        for k in range(i):
            y = y - e(f"l{i}{k}") * F.col(f"_y{k}")
        rows = rows.withColumn(f"_y{i}", y / e(f"l{i}{i}"))
    d2 = F.col("_y0") * F.col("_y0")
    for i in range(1, DIM):
        d2 = d2 + F.col(f"_y{i}") * F.col(f"_y{i}")
    return rows.withColumn("_d2", d2).drop(*(f"_y{i}" for i in range(DIM)))


def _sums(weight: str) -> list[Column]:
    w = F.col(weight)
    out = [F.sum(w).alias("w"), *(F.sum(w * F.col(x)).alias(f"s{i}") for i, x in enumerate(_X))]
    return out + [F.sum(w * F.col(_X[i]) * F.col(_X[j])).alias(f"s{i}{j}") for i, j in _PAIRS]


def _fitted(sums: DataFrame) -> DataFrame:
    """Means, factors and the factor's diagonal product from sums of whole numbers."""
    d = lambda c: F.col(c).cast("double")
    out = sums.withColumns({f"m{i}": d(f"s{i}") / d("w") for i in range(DIM)})
    product = {(i, j): d(f"s{i}{j}") / d("w") - F.col(f"m{i}") * F.col(f"m{j}") for i, j in _PAIRS}
    out = out.withColumns({f"c{i}{j}": F.greatest(c, F.lit(0.0)) + float(FLOORS[i] ** 2) if i == j else c for (i, j), c in product.items()})
    for j in range(DIM):
        for i in range(j, DIM):
            c = F.col(f"c{i}{j}")
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out = out.withColumn(f"l{i}{j}", F.sqrt(c) if i == j else c / F.col(f"l{j}{j}"))
    return out.withColumn("determinant", F.col("l00") * F.col("l11") * F.col("l22") * F.col("l33"))


def _tallied_median(tally: DataFrame, value: str, name: str) -> DataFrame:
    """The lower median per group and statistic, from a tally of values."""
    whole = Window.partitionBy(*_GROUP, "i")
    upto = tally.withColumns({"upto": F.sum("n").over(whole.orderBy(value)), "whole": F.sum("n").over(whole)})
    return upto.where("2 * upto >= whole").groupBy(*_GROUP, "i").agg(F.min(value).alias(name))


def _starts(cells: DataFrame) -> DataFrame:
    tally = cells.select(*_GROUP, F.posexplode(F.array(*_X)).alias("i", "x"), "n").groupBy(*_GROUP, "i", "x").agg(F.sum("n").alias("n"))
    medians = cut(_tallied_median(tally, "x", "m"), "quality-medians")
    apart = tally.join(medians, [*_GROUP, "i"]).select(*_GROUP, "i", F.abs(F.col("x") - F.col("m")).alias("a"), "n").groupBy(*_GROUP, "i", "a").agg(F.sum("n").alias("n"))
    both = medians.join(_tallied_median(apart, "a", "mad"), [*_GROUP, "i"])
    at = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c))).cast("double")
    wide = both.groupBy(*_GROUP).agg(*(at("m", i).alias(f"m{i}") for i in range(DIM)), *(at("mad", i).alias(f"mad{i}") for i in range(DIM)))
    zero = F.lit(0.0)

    def spherical(start: int, deviation) -> DataFrame:
        factor = [(deviation(i) if i == j else zero).alias(f"l{i}{j}") for i, j in _PAIRS]
        return wide.select(*_GROUP, F.lit(start).alias("start"), *(f"m{i}" for i in range(DIM)), *factor)

    believed = spherical(0, lambda i: F.lit(float(FLOORS[i])))
    spread = lambda i: F.lit(MAD_SCALE) * F.col(f"mad{i}")
    scaled = spherical(1, lambda i: F.sqrt(spread(i) * spread(i) + float(FLOORS[i] ** 2)))
    whole = _fitted(cells.groupBy(*_GROUP).agg(*_sums("n"))).select(*_GROUP, F.lit(2).alias("start"), *_ESTIMATE)
    return cut(believed.union(scaled).union(whole), "quality-estimates")


def _concentrated(cells: DataFrame, found: DataFrame) -> DataFrame:
    """Sums over the H documents of each group that are nearest to each estimate."""
    key = [*_GROUP, "start"]
    salted = cells.withColumn("salt", F.pmod(F.xxhash64(*_X), F.lit(SALTS)))

    def near(estimates: DataFrame, *more: str) -> DataFrame:
        spread = estimates.select(*key, *_ESTIMATE, *more, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))).alias("salt"))
        parts = with_distance(salted.join(spread, [*_GROUP, "salt"]), F.col).withColumn("q", F.floor(F.col("_d2") * DISTANCE_PARTS + 0.5).cast("bigint"))
        return parts.select(*key, *_X, "n", "salt", "q", F.floor(F.log2(F.col("q").cast("double") + 1) * BINS).cast("int").alias("bin"), *more)

    whole = Window.partitionBy(*key)
    tally = near(found).groupBy(*key, "bin").agg(F.sum("n").alias("n"))
    tally = tally.withColumns({"upto": F.sum("n").over(whole.orderBy("bin")), "whole": F.sum("n").over(whole)})
    h = F.expr(f"({SHARE_NUMERATOR} * whole + {SHARE_DENOMINATOR - 1}) div {SHARE_DENOMINATOR}")
    edges = tally.withColumn("h", h).where("upto >= h and upto - n < h").select(*key, F.col("bin").alias("edge"), (F.col("h") - F.col("upto") + F.col("n")).alias("room"))
    inside = near(found.join(edges, key), "edge", "room").where("bin <= edge").withColumn("part", F.when(F.col("bin") < F.col("edge"), F.col("salt")).otherwise(-1))
    before = F.sum("n").over(Window.partitionBy(*key, "part").orderBy("q", *_X)) - F.col("n")
    taken = inside.withColumn("taken", F.when(F.col("bin") < F.col("edge"), F.col("n")).otherwise(F.least(F.col("n"), F.col("room") - before))).where("taken > 0")
    return taken.groupBy(*key).agg(*_sums("taken"))


def estimates(rows: DataFrame) -> DataFrame:
    """Estimates from rows with keys and vectors: a row per group that has LEAST_ROWS
    documents, and one, '*', for all. Cells are tallied before any shuffle."""
    good = rows.where(~base_failed(F.col("_q.n_words"), F.col("_q.n_repeat_words")))
    own = cut(good.groupBy(*_GROUP, *_X).agg(F.count(F.lit(1)).alias("n")), "quality-cells")
    pooled = own.groupBy(*_X).agg(F.sum("n").alias("n")).select(F.lit("*").alias("_lang"), F.lit("*").alias("_source"), *_X, "n")
    cells = cut(own.unionByName(pooled), "quality-groups")
    found, before = _starts(cells), None
    for _ in range(MOST_STEPS):
        seen = Observation()  # tells whether a group changed, without a job of its own
        marks = F.xxhash64(*_GROUP, "start", "w", *(f"s{i}" for i in range(DIM)), *(f"s{i}{j}" for i, j in _PAIRS))
        sums = _concentrated(cells, found).observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(marks).alias("a"))
        found = cut(_fitted(sums).select(*_GROUP, "start", *_ESTIMATE, "determinant"), "quality-estimates")
        if seen.get == before:
            break
        before = seen.get
    rest = [c for c in _ESTIMATE]
    best = found.groupBy(*_GROUP).agg(F.min(F.struct("determinant", "start", *rest)).alias("best")).select(*_GROUP, *(F.col(f"best.{c}").alias(c) for c in rest))
    many = own.groupBy(*_GROUP).agg(F.sum("n").alias("rows")).where(F.col("rows") >= LEAST_ROWS).select(*_GROUP)
    return cut(best.join(many, _GROUP, "left_semi").union(best.where("_lang = '*'")), "quality-best")


def judged(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with vectors, plus d2, base_failed and kept. A group without an estimate of
    its own takes that of all; with no estimate at all, the base rules decide."""
    values = [c for c in found.columns if c not in ("_lang", "_source")]
    own = found.where("_lang <> '*'").select(F.col("_lang").alias("_el"), F.col("_source").alias("_es"), F.struct(*values).alias("_own"))
    everyone = F.broadcast(found.where("_lang = '*'").select(F.struct(*values).alias("_all")))  # one row
    one = rows.withColumn("_one", F.lit(1)).join(everyone.withColumn("_one", F.lit(1)), "_one", "left")
    joined = one.join(own, (F.col("_lang") == F.col("_el")) & (F.col("_source") == F.col("_es")), "left").withColumn("_e", F.coalesce("_own", "_all"))
    out = with_distance(joined, lambda c: F.col(f"_e.{c}"))
    failed = base_failed(F.col("_q.n_words"), F.col("_q.n_repeat_words"))
    return out.withColumn("_failed", failed).withColumn("_kept", ~F.col("_failed") & (F.coalesce("_d2", F.lit(0.0)) <= CUTOFF))


def report(docs: DataFrame) -> DataFrame:
    """Counts and verdict for every row of docs."""
    rows = cut(vectors(counted(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang", "source"))).drop("text"), "quality-counts")
    found = judged(rows, estimates(rows))
    counts = [F.col(f"_q.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *counts, F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def reject(docs: DataFrame) -> DataFrame:
    """The rows of docs that pass, with the same columns. Texts are read and counted
    once and never shuffled by content; the estimates are joined to them."""
    columns = [F.col("_doc").getField(c).alias(c) for c in docs.columns]
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), "text", "lang", "source")
    rows = cut(vectors(counted(packed)).drop("text"), "quality-counts")
    return judged(rows, estimates(rows)).where("_kept").select(*columns)
