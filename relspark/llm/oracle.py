"""The same results in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from relspark.llm import mixing, quality, sharding

OP1 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5
"""

_LIVE = "(SELECT tokens / (SELECT sum(tokens) FROM tot) AS p FROM tot WHERE tokens > 0) AS live"
_ENTROPY = "ln(sum(pow(p, a))) - sum(pow(p, a) * ln(pow(p, a))) / sum(pow(p, a))"
_REPEATS = "max(pow(p, a - 1)) / sum(pow(p, a))"


def _bisection(name: str, start: str, holds: str) -> str:
    return f"""{name}(i, low, high) AS (
  {start}
  UNION ALL
  SELECT i + 1, CASE WHEN holds THEN middle ELSE low END, CASE WHEN holds THEN high ELSE middle END
  FROM (SELECT i, low, high, middle, {holds} AS holds FROM (
    SELECT i, low, high, (low + high) // 2 AS middle, ((low + high) // 2) / {mixing.GRID}.0 AS a, p FROM {name}, {_LIVE} WHERE i < {mixing.BISECTIONS}
  ) GROUP BY i, low, high, middle)
)"""


OP2 = f"""
WITH RECURSIVE m AS MATERIALIZED (
  SELECT doc_id, source, coalesce('=' || source, '') AS s,
    len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS tokens,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS hash
  FROM documents
), tot AS MATERIALIZED (SELECT s, count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens FROM m GROUP BY s
), goal AS MATERIALIZED (SELECT {mixing.TARGET_ENTROPY} * ln(greatest(count(*), 1)) - 1e-9 AS wanted FROM tot WHERE tokens > 0
), {_bisection("warm", f"SELECT 0, CAST(0 AS BIGINT), CAST({mixing.GRID} AS BIGINT)", f"{_ENTROPY} >= (SELECT wanted FROM goal)")},
flat AS MATERIALIZED (
  SELECT CASE WHEN (SELECT {_ENTROPY} FROM (SELECT p, 1.0 AS a FROM {_LIVE})) >= (SELECT wanted FROM goal) THEN {mixing.GRID} ELSE max(low) END AS e FROM warm WHERE i = {mixing.BISECTIONS}
), {_bisection("cool", f"SELECT 0, e, CAST({mixing.GRID} AS BIGINT) FROM flat", f"{_REPEATS} > {mixing.MAX_REPEATS} + 1e-9")},
chosen AS MATERIALIZED (
  SELECT CASE WHEN (SELECT {_REPEATS} FROM (SELECT p, (SELECT e FROM flat) / {mixing.GRID}.0 AS a FROM {_LIVE})) <= {mixing.MAX_REPEATS} + 1e-9 THEN (SELECT e FROM flat) ELSE max(high) END / {mixing.GRID}.0 AS a
  FROM cool WHERE i = {mixing.BISECTIONS}
), w AS MATERIALIZED (
  SELECT s, n, tokens, (SELECT sum(tokens) FROM tot) AS whole,
    CASE WHEN tokens > 0 THEN CAST(round(pow(tokens / (SELECT sum(tokens) FROM tot), (SELECT a FROM chosen)) / (SELECT sum(pow(p, (SELECT a FROM chosen))) FROM {_LIVE}) * {mixing.PPM}) AS BIGINT) ELSE 0 END AS weight_ppm
  FROM tot
), b AS MATERIALIZED (
  SELECT *, budget - passes * tokens AS rest FROM (
    SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 1 END AS passes, CAST(ceil(n / {mixing.BLOCK_ROWS}.0) AS BIGINT) AS blocks
    FROM (SELECT *, CAST(floor(weight_ppm * whole / {mixing.PPM}.0) AS BIGINT) AS budget FROM w))
), d AS MATERIALIZED (
  SELECT m.doc_id, m.source, m.s, m.tokens, m.hash, b.weight_ppm, b.budget, b.passes, b.rest, m.hash % b.blocks AS block FROM m JOIN b ON m.s = b.s
), k AS (
  SELECT s, block, upto <= rest AS whole, rest - (upto - tokens) AS room FROM (
    SELECT *, sum(tokens) OVER (PARTITION BY s ORDER BY CAST('0x' || substr(md5(s || '|' || CAST(block AS VARCHAR)), 1, 13) AS BIGINT), block) AS upto
    FROM (SELECT s, block, rest, sum(tokens) AS tokens FROM d GROUP BY s, block, rest))
)
SELECT doc_id, source, CAST(d.tokens AS BIGINT) AS n_tokens, weight_ppm, budget, d.block AS block,
  CAST(passes + CASE
    WHEN d.tokens = 0 THEN 0 WHEN k.whole THEN 1
    WHEN sum(d.tokens) OVER (PARTITION BY d.s, d.block, d.tokens > 0 ORDER BY hash, doc_id) <= k.room THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM d JOIN k ON d.s = k.s AND d.block = k.block
"""

_OP3_COUNTS = r"""
t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g')) > 0) AS lines
  FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS gram FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM t)
), r AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1
), c AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM r) GROUP BY doc_id
), q AS (
  SELECT t.doc_id, coalesce('=' || lang, '') AS _lang, coalesce('=' || source, '') AS _source,
    CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines
  FROM t LEFT JOIN c ON t.doc_id = c.doc_id
), x AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CAST(floor(100 * sqrt(CAST(word_chars AS DOUBLE) / greatest(CAST(n_words AS DOUBLE), 1.0))) AS BIGINT) AS x1,
    CAST(floor(100 * sqrt(CAST(n_symbols AS DOUBLE) / greatest(CAST(n_words AS DOUBLE), 1.0))) AS BIGINT) AS x2,
    CAST(floor(100 * sqrt(CAST(n_dup_lines AS DOUBLE) / greatest(CAST(n_lines AS DOUBLE), 1.0))) AS BIGINT) AS x3,
    CAST(floor(100 * sqrt(CAST(n_repeat_words AS DOUBLE) / greatest(CAST(n_words AS DOUBLE), 1.0))) AS BIGINT) AS x4
  FROM q
)"""


def _mcd(steps: int) -> str:
    """Estimates by windows over all cells of a group, from fixed values of quality.py."""
    floors, p = quality.FLOORS, range(4)
    fit = "SELECT _lang, _source, start, " + ", ".join(f"CAST(sum(k) AS BIGINT) AS k{'' if i < 0 else i}" if i < 0 else f"CAST(sum(k * x{i + 1}) AS BIGINT) / CAST(sum(k) AS DOUBLE) AS a{i}" for i in (-1, *p))
    for i in p:
        for j in range(i + 1):
            v = f"CAST(sum(k * x{i + 1} * x{j + 1}) AS BIGINT) / CAST(sum(k) AS DOUBLE) - CAST(sum(k * x{i + 1}) AS BIGINT) / CAST(sum(k) AS DOUBLE) * (CAST(sum(k * x{j + 1}) AS BIGINT) / CAST(sum(k) AS DOUBLE))"
            fit += f", greatest({v}, 0.0) + {floors[i] ** 2}.0 AS v{i}{i}" if i == j else f", {v} AS v{i}{j}"

    def factored(source: str) -> str:
        """Cholesky's factor f of the covariance v, a row at a time."""
        return f"""SELECT *, f00 * f11 * f22 * sqrt(v33 - f30 * f30 - f31 * f31 - f32 * f32) AS root, sqrt(v33 - f30 * f30 - f31 * f31 - f32 * f32) AS f33 FROM (
          SELECT *, (v32 - f30 * f20 - f31 * f21) / f22 AS f32 FROM (
          SELECT *, sqrt(v22 - f20 * f20 - f21 * f21) AS f22, (v31 - f30 * f10) / f11 AS f31 FROM (
          SELECT *, (v21 - f20 * f10) / f11 AS f21 FROM (
          SELECT *, sqrt(v11 - f10 * f10) AS f11 FROM (
          SELECT *, v10 / f00 AS f10, v20 / f00 AS f20, v30 / f00 AS f30 FROM (
          SELECT *, sqrt(v00) AS f00 FROM ({source}))))))) """

    names = "a0, a1, a2, a3, f00, f10, f11, f20, f21, f22, f30, f31, f32, f33"
    spherical = "SELECT _lang, _source, {} AS start, CAST(c1 AS DOUBLE), CAST(c2 AS DOUBLE), CAST(c3 AS DOUBLE), CAST(c4 AS DOUBLE), {}, 0.0, {}, 0.0, 0.0, {}, 0.0, 0.0, 0.0, {} FROM middle"
    scaled = [f"sqrt({quality.MAD_SCALE} * CAST(t{i + 1} AS DOUBLE) * ({quality.MAD_SCALE} * CAST(t{i + 1} AS DOUBLE)) + {floors[i] ** 2}.0)" for i in p]
    parts = [
        "tally AS MATERIALIZED (SELECT _lang, _source, x1, x2, x3, x4, count(*) AS n FROM x WHERE NOT base_failed GROUP BY ALL)",
        "cells AS MATERIALIZED (SELECT * FROM tally UNION ALL SELECT '*', '*', x1, x2, x3, x4, CAST(sum(n) AS BIGINT) FROM tally GROUP BY ALL)",
        "rows AS (SELECT _lang, _source, x1, x2, x3, x4 FROM cells, range(n))",
        "centre AS MATERIALIZED (SELECT _lang, _source, " + ", ".join(f"quantile_disc(x{i + 1}, 0.5) AS c{i + 1}" for i in p) + " FROM rows GROUP BY ALL)",
        "middle AS MATERIALIZED (SELECT _lang, _source, " + ", ".join(f"any_value(c{i + 1}) AS c{i + 1}, quantile_disc(abs(x{i + 1} - c{i + 1}), 0.5) AS t{i + 1}" for i in p) + " FROM rows JOIN centre USING (_lang, _source) GROUP BY ALL)",
        f"e0(_lang, _source, start, {names}) AS MATERIALIZED ({spherical.format(0, *(f'{f}.0' for f in floors))} UNION ALL {spherical.format(1, *scaled)} UNION ALL "
        f"SELECT _lang, _source, start, {names} FROM ({factored(fit + ' FROM (SELECT *, 2 AS start, n AS k FROM cells) GROUP BY _lang, _source, start')}))",
    ]
    for step in range(1, steps + 1):
        taken = f"""SELECT *, least(n, h - before) AS k FROM (
          SELECT *, (3 * sum(n) OVER (PARTITION BY _lang, _source, start) + 3) // 4 AS h, sum(n) OVER (PARTITION BY _lang, _source, start ORDER BY q, x1, x2, x3, x4) - n AS before
          FROM (SELECT *, CAST(floor(d2 * {quality.DISTANCE_PARTS} + 0.5) AS BIGINT) AS q FROM ({_DISTANCE.format(source=f"SELECT * FROM cells JOIN e{step - 1} USING (_lang, _source)")}))) WHERE before < h"""
        parts.append(f"e{step} AS MATERIALIZED (SELECT _lang, _source, start, {names}, root FROM ({factored(fit + f' FROM ({taken}) GROUP BY _lang, _source, start')}))")
    parts.append(f"""est AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY _lang, _source ORDER BY root, start) AS place FROM e{steps}) WHERE place = 1
      AND (_lang = '*' OR (_lang, _source) IN (SELECT (_lang, _source) FROM tally GROUP BY _lang, _source HAVING sum(n) >= {quality.LEAST_ROWS})))""")
    return ", ".join(parts)


#: The squared length of the solution of f * z = x - a.
_DISTANCE = """SELECT *, z0 * z0 + z1 * z1 + z2 * z2 + z3 * z3 AS d2 FROM (
  SELECT *, (CAST(x4 AS DOUBLE) - a3 - f30 * z0 - f31 * z1 - f32 * z2) / f33 AS z3 FROM (
  SELECT *, (CAST(x3 AS DOUBLE) - a2 - f20 * z0 - f21 * z1) / f22 AS z2 FROM (
  SELECT *, (CAST(x2 AS DOUBLE) - a1 - f10 * z0) / f11 AS z1 FROM (
  SELECT *, (CAST(x1 AS DOUBLE) - a0) / f00 AS z0 FROM ({source})))))"""
_JUDGED = "SELECT x.*, e.* EXCLUDE (_lang, _source) FROM x LEFT JOIN est AS own ON own._lang = x._lang AND own._source = x._source LEFT JOIN est AS e ON e._lang = coalesce(own._lang, '*') AND e._source = coalesce(own._source, '*')"
OP3 = f"""
WITH {_OP3_COUNTS}, {_mcd(quality.MOST_STEPS)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(d2, 0.0) <= {quality.CUTOFF} AS kept
FROM ({_DISTANCE.format(source=_JUDGED)})
"""

OP5 = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), g AS (
  SELECT doc_id, CASE
    WHEN len(words) >= 2 THEN list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))
    WHEN len(words) = 1 THEN words ELSE [] END AS shingles
  FROM w
), e AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS s FROM g
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), least_id AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM g JOIN least_id ON doc_id = x
"""

# CRC-32 goes by half bytes, as its table of 16 entries follows from the polynomial.
OP8 = f"""
WITH RECURSIVE half AS MATERIALIZED (
  SELECT list(list_reduce(range(4), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CAST(n AS BIGINT)) ORDER BY n) AS t FROM range(16) r(n)
), raw AS MATERIALIZED (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS h FROM documents
), nibbles AS MATERIALIZED (
  SELECT row_id, doc_id, strlen(text) AS bytes, list_transform(CASE WHEN h = '' THEN [] ELSE string_split(h, '') END, lambda x: instr('0123456789ABCDEF', x) - 1) AS l FROM raw
), d AS MATERIALIZED (
  SELECT row_id, doc_id, CAST(bytes + 1 AS BIGINT) AS size,
    xor(list_reduce(list_transform(range(2 * bytes), lambda i: l[CASE WHEN i % 2 = 0 THEN i + 2 ELSE i END]),
      lambda c, x: xor(c >> 4, half.t[CAST(xor(c, x) & 15 AS INTEGER) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) % {sharding.SLOTS} AS virtual_slot
  FROM nibbles, half
), t AS MATERIALIZED (
  SELECT virtual_slot, CAST(sum(size) AS BIGINT) AS slot_bytes, count(*) AS slot_rows, row_number() OVER (ORDER BY sum(size) DESC, virtual_slot) AS k FROM d GROUP BY virtual_slot
), filled(k, load, shard, virtual_slot, slot_rows) AS (
  SELECT CAST(0 AS BIGINT), list_transform(range({sharding.SHARDS}), lambda i: CAST(0 AS BIGINT)), CAST(NULL AS INTEGER), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT)
  UNION ALL
  SELECT t.k, list_transform(load, lambda v, i: v + CASE WHEN i = list_position(load, list_min(load)) THEN t.slot_bytes ELSE 0 END),
    CAST(list_position(load, list_min(load)) - 1 AS INTEGER), t.virtual_slot, t.slot_rows
  FROM filled JOIN t ON t.k = filled.k + 1
), starts AS (
  SELECT virtual_slot, shard, coalesce(sum(slot_rows) OVER (PARTITION BY shard ORDER BY virtual_slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS slot_start
  FROM filled WHERE virtual_slot IS NOT NULL
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  CAST(slot_start + row_number() OVER (PARTITION BY d.virtual_slot ORDER BY doc_id, text_crc32, size) - 1 AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, d.virtual_slot, CAST(1 AS INTEGER) AS map_version
FROM d JOIN starts ON d.virtual_slot = starts.virtual_slot
"""

OP9 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""

OP10 = """
WITH b AS MATERIALIZED (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, md5_number(substring(h, CAST(2 * i + 1 AS BIGINT), 200)) AS piece FROM (SELECT doc_id, h, unnest(range(n_bytes - 99)) AS i FROM b WHERE n_bytes >= 100)
), f AS (
  SELECT doc_id, i, min({'d': doc_id, 'i': i}) OVER (PARTITION BY piece) AS first FROM w
), r AS (
  SELECT doc_id, i, max(i + 100) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM f WHERE first <> {'d': doc_id, 'i': i}
), g AS (
  SELECT doc_id, i, sum(CASE WHEN before >= i THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r
), s AS (
  SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM s
  UNION ALL
  SELECT doc_id, max(z), 1000000000 FROM s GROUP BY doc_id
), kept AS (
  SELECT gaps.doc_id, string_agg(substring(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (z - a) AS BIGINT)), '' ORDER BY a) AS h FROM gaps JOIN b ON gaps.doc_id = b.doc_id GROUP BY gaps.doc_id
), totals AS (SELECT doc_id, sum(z - a) AS n, count(*) AS c FROM s GROUP BY doc_id)
SELECT b.doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(c, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, b.h))) AS kept_sha256
FROM b LEFT JOIN totals ON b.doc_id = totals.doc_id LEFT JOIN kept ON b.doc_id = kept.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_pivot_topk": OP1, "op2_temperature_mixing": OP2, "op3_robust_outliers": OP3, "op5_minhash_classes": OP5, "op8_virtual_slots": OP8, "op9_arc_to_warc": OP9, "op10_bwt_repeats": OP10}
