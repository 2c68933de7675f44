from datetime import datetime as dt

import pytest

from quillgraph.operators import references

NOTE = "id string, deleted_at timestamp_ntz, ingested_at timestamp_ntz, key string, kind string"
CHUNK = "id string, note_id string, ingested_at timestamp_ntz, refs int, tbl string"
NODE = "id string, provenance string, ingested_at timestamp_ntz, ref_key string"
EDGE = "id string, source string, target string, ingested_at timestamp_ntz, seen string"
J, F, M = dt(2024, 1, 5), dt(2024, 2, 5), dt(2024, 3, 5)


@pytest.fixture(scope="module")
def tables(spark):
    notes = spark.createDataFrame([("a", None, J, "x", "y"), ("a", None, M, "x", "y"), ("b", F, J, "x", "y"), ("late", None, M, None, None), (None, None, J, None, None)], NOTE)
    chunks = spark.createDataFrame([("c1", "A ", J, 1, "t"), ("c2", " b", J, 1, "t"), ("c3", "gone", F, 1, "t"), ("c3", "gone", M, 1, "t"), ("c4", "late", J, 1, "t"), ("c5", None, J, 1, "t"), ("c6", "  ", J, 1, "t"), (None, "gone", J, 1, "t"), ("c7", "x" * 100000, J, 1, "t")], CHUNK)
    nodes = spark.createDataFrame([("n1", '["c1", "c9", "c9"]', J, "x"), ("n2", "['C2']", J, "x"), ("n3", "c8, c1; c7", J, "x"), ("n4", None, J, "x"), ("n5", "[]", J, "x"), ("n6", "", None, "x"), ("n7", "[null]", J, "x")], NODE)
    edges = spark.createDataFrame([("E1", "n1", " N2", J, "x"), ("E1", "n1", "n2", M, "x"), ("E2", "n9", "n6", J, "x"), ("E3", None, "", J, "x")] + [(f"H{i}", "hub", "n1", F, "x") for i in range(3000)], EDGE)
    return notes, chunks, nodes, edges


def test_orphans(tables):
    got = [tuple(r) for r in references.orphans(*tables).collect()]
    assert len(got) == len(set(got))
    small = {g for g in got if not g[2].startswith("H")}
    assert small == {
        ("chunks", "note_id", "c2", "b", "deleted", "2024-01"), ("chunks", "note_id", "c3", "gone", "missing", "2024-02"), ("chunks", "note_id", "c4", "late", "late", "2024-01"), ("chunks", "note_id", "c7", "x" * 100000, "missing", "2024-01"),
        ("nodes", "provenance", "n1", "c9", "missing", "2024-01"), ("nodes", "provenance", "n2", "c2", "deleted", "2024-01"), ("nodes", "provenance", "n3", "c8", "missing", "2024-01"), ("edges", "source", "E2", "n9", "missing", "2024-01"),
    }
    assert {g for g in got if g[2].startswith("H")} == {("edges", "source", f"H{i}", "hub", "missing", "2024-02") for i in range(3000)}
    report = references.orphan_report(references.orphans(*tables)).where("field = 'source' AND period = '2024-02'").first()
    assert (report.n_refs, report.n_keys) == (3000, 1)


def test_empty(spark):
    none = [spark.createDataFrame([], s) for s in (NOTE, CHUNK, NODE, EDGE)]
    assert references.orphans(*none).count() == 0


def test_all_missing_when_target_is_empty(tables, spark):
    notes = spark.createDataFrame([], NOTE)
    got = references.orphans(notes, *tables[1:]).where("tbl = 'chunks'").collect()
    assert {r.kind for r in got} == {"missing"} and len(got) == 5


def test_changes_equal_a_full_run(tables, spark):
    """Rows that come, go, are retracted or move to another key: the state after the deltas is that of the end tables."""
    notes, chunks, nodes, edges = tables
    old = (
        notes.where("id <> 'b' OR id IS NULL").unionByName(spark.createDataFrame([("b", None, J, "x", "y"), ("gone", None, J, None, None)], NOTE)),
        chunks.where("id <> 'c1' OR id IS NULL").unionByName(spark.createDataFrame([("c1", "gone", J, 1, "t"), ("c9", "a", F, 1, "t")], CHUNK)),
        nodes.where("id <> 'n1'").unionByName(spark.createDataFrame([("n1", "[c1]", F, "x"), ("n9", None, J, "x")], NODE)),
        edges.where("id <> 'E1'").unionByName(spark.createDataFrame([("E1", "n1", "n5", J, "x"), ("E1", "n7", "n5", J, "x")], EDGE)),
    )
    went = [o.exceptAll(n) for o, n in zip(old, tables)]
    came = [n.exceptAll(o) for o, n in zip(old, tables)]
    records = references.added_up(references.record_deltas(*old[:3]))
    refs = references.added_up(references.reference_deltas(*old[1:]))
    records = references.changed(records, references.record_deltas(*went[:3], sign=-1).unionByName(references.record_deltas(*came[:3])))
    refs = references.changed(refs, references.reference_deltas(*went[1:], sign=-1).unionByName(references.reference_deltas(*came[1:])))
    want = references.added_up(references.record_deltas(*tables[:3]))
    assert want.exceptAll(records).count() == 0 and records.exceptAll(want).count() == 0
    got, full = references.orphans_of(records, refs), references.orphans(*tables)
    assert got.exceptAll(full).count() == 0 and full.exceptAll(got).count() == 0
    assert references.orphans(*old).exceptAll(full).count() > 0


def test_all_goes(tables):
    records = references.record_deltas(*tables[:3]).unionByName(references.record_deltas(*tables[:3], sign=-1))
    assert references.added_up(records).count() == 0
