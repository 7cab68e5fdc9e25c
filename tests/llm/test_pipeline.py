"""The pipeline against the brute-force versions of its stages, and the oracles."""

from __future__ import annotations

import os
import random
import shutil
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline

sys.path.insert(0, str(Path(__file__).parent))
import test_minhash  # noqa: E402
import test_packing  # noqa: E402
import test_quality  # noqa: E402

from relspark.llm.oracle import oracle_sql  # noqa: E402
from relspark.llm.queries import queries  # noqa: E402

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def corpus() -> list:
    """Junk, near copies, shared passages and sources of unequal sizes."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(40))
    rows = []
    for i in range(160):
        words = [word() for _ in range(rng.randint(15, 90))]
        if i % 9 == 0:
            words = [w + "##%%" for w in words]
        if i % 11 == 0:
            words = words[:4]
        text = " ".join(words)
        if i % 5 == 0:
            text += "\n" + passage + "\n" + " ".join(word() for _ in range(60))
        if i % 7 == 0 and rows:
            text = rng.choice(rows)[1] + " " + word()
        rows.append((i, text, "en", "main" if i % 4 else "side"))
    return rows


def removed(rows) -> list:
    seen: set = set()
    out = []
    for i, text, lang, source in sorted(rows):
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - 99):
            piece = raw[at : at + 100]
            if piece in seen:
                gone[at : at + 100] = True
            seen.add(piece)
        left = bytes(np.frombuffer(raw, np.uint8)[~gone]).decode()
        if left.strip() or not gone.any():
            out.append((i, left, lang, source))
    return out


def test_stages_against_brute_force(spark, documents, tmp_path):
    rows = corpus()
    path = str(tmp_path / "documents.parquet")
    documents(rows).write.parquet(path)
    docs = spark.read.parquet(path)
    columns = docs.columns

    verdict = test_quality.brute(rows)
    rows = [r for r in rows if verdict[r[0]][-1]]
    label = test_minhash.brute([(r[0], r[1]) for r in rows])
    near = [r for r in rows if label[r[0]] == r[0]]
    cleaned = removed(near)
    assert 20 < len(cleaned) < len(rows) < 160
    assert any(a[1] != b[1] for a, b in zip(sorted(near), cleaned, strict=False))

    for (_, stage), expected in zip(corpus_pipeline.STAGES[:3], (rows, near, cleaned), strict=True):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns
        assert sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect()) == sorted((r[0], r[1], len(r[1])) for r in expected)
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    assert mixed.columns == columns
    copies = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert set(copies) == {(r[0], r[1]) for r in cleaned}

    # The whole run packs each copy once.
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    per_doc = Counter()
    for r in packed:
        per_doc[r.doc_id] += r.length
    exact = test_packing.reference()
    assert per_doc == {i: n * (len(exact.encode(t, add_special_tokens=False).ids) + 1) for (i, t), n in copies.items()}


def test_one_stage_per_operator():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "mixing", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_against_duckdb(spark, duck, name):
    ours = queries()[name](spark, SF)
    theirs = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in theirs.description]
    assert sorted(columns) == sorted(ours.columns)
    at = [columns.index(c) for c in ours.columns]
    assert sorted(map(tuple, ours.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in theirs.fetchall()), key=repr)


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))


def test_the_rest_works_without_this_subpackage(tmp_path):
    root = Path(corpus_pipeline.__file__).parent
    for part in ("relspark", "__spark_entry__.py"):
        source = root / part
        if source.is_dir():
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / part)
    done = os.popen(f"cd {tmp_path} && PYTHONPATH={tmp_path} {sys.executable} -c \"import __spark_entry__ as e; print('ok', len(e.queries()) > 40, [n for n in e.queries() if n.startswith('op1')])\" 2>/dev/null").read()
    assert "ok True []" in done
