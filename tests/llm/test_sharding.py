from __future__ import annotations

import zlib
from collections import Counter

from relspark.llm import sharding


def test_every_row_has_a_place(documents):
    rows = [(i, "x" * (i * 37 % 500)) for i in range(3000)] + [(5000, None), (5001, "é"), (7, "again")]
    found = sharding.shard(documents(rows)).collect()
    assert len(found) == len(rows)
    text = {5001: "é", 5000: ""}
    for r in found:
        if r.doc_id in text:
            raw = text[r.doc_id].encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    for shard in range(8):
        places = sorted(r.slot for r in found if r.shard == shard)
        assert places == list(range(len(places)))
    sizes = Counter()
    for r in found:
        sizes[r.shard] += r.size
    assert set(sizes) == set(range(8))
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 8
    assert {(r.law, r.grown_shard) for r in found} == {("bytes", None)}


def test_a_hot_id_and_one_large_text(documents):
    found = sharding.shard(documents([(1, "a")] * 500 + [(i, "b" * 40) for i in range(2, 500)] + [(999, "c" * 100_000)])).collect()
    assert len(found) == 999
    assert len({(r.shard, r.slot) for r in found}) == 999


def test_adding_a_shard_moves_slots_only_to_it(spark, documents, tmp_path):
    rows = sharding.sized(documents([(i, "x" * (i * 31 % 97)) for i in range(20000)]))
    first = sharding.build_map(sharding.slot_totals(rows))
    second = sharding.add_shard(first)
    for _ in range(2):  # a retried job changes nothing
        sharding.write_map(first, str(tmp_path / "map"), 1)
        sharding.write_map(second, str(tmp_path / "map"), 2)
    before = {r.virtual_slot: r.shard for r in sharding.read_map(spark, str(tmp_path / "map"), 1).collect()}
    after = {r.virtual_slot: r.shard for r in sharding.read_map(spark, str(tmp_path / "map")).collect()}
    assert set(before) == set(after)
    moved = [s for s in before if before[s] != after[s]]
    assert all(after[s] == 8 for s in moved)
    load = Counter()
    for r in second.collect():
        load[r.shard] += r.slot_bytes
    assert min(load.values()) > 0.9 * sum(load.values()) / 9
    assert max(load.values()) < 1.05 * sum(load.values()) / 9


def test_the_stored_map_is_edited_where_shards_drift_apart(spark, documents, tmp_path):
    """Later documents go by the stored map, of which only overloaded shards' slots and new
    slots move."""
    path = str(tmp_path / "maps")
    rows = [(i, "x" * 50) for i in range(3000)]
    first = sharding.shard(documents(rows), path=path).collect()
    assert {r.map_version for r in first} == {1}
    home = {r.virtual_slot: r.shard for r in first}
    # One shard's documents grow, and new ones come.
    grown = [(r.doc_id, "x" * (400 if r.shard == 3 else 50)) for r in first] + [(i, "y" * 50) for i in range(3000, 3500)]
    second = sharding.shard(documents(grown), path=path).collect()
    assert {r.map_version for r in second} == {2}
    assert sharding.read_map(spark, path, 1).count() == len(home)
    moved = {r.virtual_slot for r in second if r.virtual_slot in home and home[r.virtual_slot] != r.shard}
    assert moved and {home[s] for s in moved} == {3}
    load = Counter()
    for r in second:
        load[r.shard] += r.size
    assert max(load.values()) - min(load.values()) < 0.03 * sum(load.values()) / 8
    for shard in range(8):
        places = sorted(r.slot for r in second if r.shard == shard)
        assert places == list(range(len(places)))


def test_awkward_and_empty_tables(awkward, documents):
    assert sharding.shard(awkward).count() == 13
    assert sharding.shard(documents([])).count() == 0


def test_no_python_in_the_plans(documents):
    plan = sharding.shard(documents([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
