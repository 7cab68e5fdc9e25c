from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from relspark.llm import packing


def reference() -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


TEXTS = ["", "Hello world", "  spaces   and\n\nlines\t", "ünïcode ñandú çà 12345", "日本語 and кириллица", "😀 emoji 👩‍👩‍👧", "don't we'll I'd", "<|endoftext|> is text", "a" * 5000, "\x00\x01\x7f", "word " * 3000, " ", "é" * 999]


def test_both_libraries_give_the_same_ids():
    encode, exact = packing.encoder(), reference()
    for text in TEXTS:
        assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_strings_of_special_tokens():
    assert packing.encoder()("x <|endoftext|> y").tolist() == [87, 220, 50256, 331]
    assert 50256 not in packing.encoder(special_as_text=True)("x <|endoftext|> y").tolist()


def test_nnls_against_normal_equations():
    rng = np.random.default_rng(1)
    a, b = rng.random((8, 5)), rng.random(8)
    x = packing.nnls(a, b)
    gradient = a.T @ (a @ x - b)
    assert (x >= 0).all()
    assert (gradient > -1e-8).all()
    assert np.abs(gradient * x).max() < 1e-8


def test_combinations_fill_the_window():
    a = packing.combinations(12, 3)
    assert {tuple(sorted(np.repeat(np.arange(1, 13), c.astype(int)))) for c in a.T} == {(i, j, 12 - i - j) for i in range(1, 13) for j in range(i, 13) if 12 - i - j >= j} | {(i, 12 - i) for i in range(1, 7)} | {(12,)}


@pytest.mark.parametrize("seed", range(12))
def test_pack_lengths_uses_each_token_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, rng.choice([3, 50, 2048, 9000]), rng.integers(1, 400))
    full, short = packing.pack_lengths(lengths)
    rows = full + packing.powers_of_two(short)
    assert all(sum(p[2] for p in r) == packing.WINDOW for r in full)
    assert all(n & (n - 1) == 0 for r in rows if (n := sum(p[2] for p in r)))
    pieces = sorted(p for r in rows for p in r)
    at = {}
    for doc, start, length in pieces:
        assert length > 0 and start == at.get(doc, 0)
        at[doc] = start + length
    assert at == dict(enumerate(lengths.tolist()))


@pytest.mark.parametrize(("least", "most", "n"), [(20, 400, 8000), (1, 40, 30_000), (1, 5, 20_000), (1, 2048, 2000), (1, 6000, 1000)])
def test_the_solver_plans_documents_of_all_lengths(least, most, n):
    """Of the tokens outside whole windows, most lie in planned sequences, and most of
    these stay as planned."""
    lengths = np.random.default_rng(least).integers(least, most + 1, n)
    rest = lengths % packing.WINDOW
    rest = rest[rest > 0]
    sequences, left = packing.plan(rest)
    assert sorted([d for s in sequences for d in s] + left) == list(range(len(rest)))
    assert all(rest[s].sum() <= packing.WINDOW for s in sequences)
    assert sum(int(rest[s].sum()) for s in sequences) > 0.6 * rest.sum()
    full, _ = packing.pack_lengths(lengths)
    docs = np.flatnonzero(lengths % packing.WINDOW)
    home = {d: i for i, r in enumerate(full) for d, _, size in r if size == lengths[d] % packing.WINDOW}
    kept = sum(len({home.get(int(docs[d]), -d) for d in s}) == 1 for s in sequences)
    assert kept > 0.9 * len(sequences)


def test_lengths_that_no_combination_fills():
    """Documents of one length that nothing completes are all left to the filler."""
    full, short = packing.pack_lengths(np.full(900, 91))
    assert sum(n for r in full for _, _, n in r) + sum(n for _, _, n in short) == 900 * 91
    assert all(sum(p[2] for p in r) == packing.WINDOW for r in full)


def check(found, rows):
    """Every id of every document in exactly one piece; sequences gapless and unpadded."""
    exact = reference()
    ids = {i: [*exact.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for doc, pieces in by_doc.items():
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[doc])
            part = np.array(ids[doc][at : at + p.length], "<u4")
            assert p.ids_crc32 == zlib.crc32(part.tobytes())
            at += p.length
        assert at == len(ids[doc])
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= packing.WINDOW and at & (at - 1) == 0 and all(p.sequence_length == at for p in pieces)


def test_round_trip(documents):
    rows = list(enumerate([*TEXTS, None, *(f"text {i} " * (i % 37 * 11) for i in range(300))]))
    check(packing.pack(documents(rows).repartition(3)).collect(), rows)


def test_carry_between_blocks():
    packer = packing._Packer(7)
    rng = np.random.default_rng(2)
    seen: dict = {}
    for block in range(5):
        for d in range(20):
            ids = rng.integers(0, 50000, rng.integers(1, 900)).astype(np.uint32)
            seen[block * 100 + d] = ids
            packer.add(block * 100 + d, ids, 0, len(ids))
        for r in packer.flush(last=block == 4).to_pylist():
            part = seen[r["doc_id"]][r["start"] : r["start"] + r["length"]]
            assert zlib.crc32(part.astype("<u4").tobytes()) == r["ids_crc32"]
            seen.setdefault("n", {}).setdefault(r["doc_id"], []).append(r["length"])
    lengths = seen.pop("n")
    assert {k: sum(v) for k, v in lengths.items()} == {k: len(v) for k, v in seen.items()}


def test_awkward_and_empty_tables(awkward, documents):
    found = packing.pack(awkward).collect()
    per_doc = {}
    for r in found:
        per_doc[r.doc_id] = per_doc.get(r.doc_id, 0) + r.length
    assert per_doc[3] == per_doc[4] == 1
    assert per_doc[1] == 2 * next(r.doc_tokens for r in found if r.doc_id == 1)
    assert None in per_doc
    assert packing.pack(documents([])).count() == 0
