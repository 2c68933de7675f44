from datetime import datetime as dt

from pyspark.sql import functions as F

from quillgraph.operators import vault

J, M = dt(2024, 1, 5), dt(2024, 3, 5)


def build(spark, deleted):
    notes = spark.createDataFrame([("note1", J if deleted else None, J), ("note2", None, J)], "id string, deleted_at timestamp_ntz, ingested_at timestamp_ntz")
    chunks = spark.createDataFrame([("c1", "note1", J), ("c2", " NOTE2", J)], "id string, note_id string, ingested_at timestamp_ntz")
    nodes = spark.createDataFrame([("P", '["c1"]', J), ("Q", '["c2"]', J), ("S", '["c1", "c2"]', J), ("free", "[]", J)], "id string, provenance string, ingested_at timestamp_ntz")
    edges = spark.createDataFrame([("e1", "P", "S", "KNOWS", 0.0, None, '["c1"]', J), ("e2", "Q", "S", "KNOWS", 2.0, 0.5, '["c2"]', J)], "id string, source string, target string, predicate string, weight double, confidence double, provenance string, ingested_at timestamp_ntz")
    communities = spark.createDataFrame([(1, 0, None, '["P", "Q", "S"]'), (2, 0, None, '["P"]')], "id bigint, level int, parent_id bigint, node_ids string")
    return nodes, edges, communities, chunks, notes


def ids(df):
    return {r.id for r in df.select("id").collect()}


def test_soft_delete_hides_and_restore_returns(spark):
    nodes, edges, communities, chunks, notes = build(spark, True)
    assert ids(vault.active_nodes(nodes, chunks, notes)) == {"Q", "S", "free"}
    assert ids(vault.active_edges(edges, nodes, chunks, notes)) == {"e2"}
    left = vault.active_nodes(nodes, chunks, notes)
    assert {(r.id, r.n_active) for r in vault.active_communities(communities, left).collect()} == {(1, 2)}
    back = vault.restore(notes, spark.createDataFrame([("note1.md",)], "id string"))
    assert ids(vault.active_nodes(nodes, chunks, back)) == {"P", "Q", "S", "free"}


def test_purge_counts(spark):
    got = {r.what: r.n for r in vault.purge_counts(*build(spark, True)).collect()}
    assert got == {"notes": 1, "chunks": 1, "nodes": 1, "edges": 1, "communities": 1}


def test_soft_delete_marks_and_adds_tombstones(spark):
    notes = build(spark, False)[-1]
    got = {r.id: r.deleted_at for r in vault.soft_delete(notes, spark.createDataFrame([("note2.md",), ("new",)], "id string"), F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")).collect()}
    assert got["note1"] is None and got["note2"] == got["new"] == dt(2024, 5, 1)


def test_edge_view_and_degrees(spark):
    nodes, edges, _, _, _ = build(spark, False)
    view = {r.id: r for r in vault.edge_view(edges).collect()}
    assert (view["e1"].weight, view["e1"].confidence, view["e2"].weight, view["e2"].confidence) == (1.0, 1.0, 2.0, 0.5)
    loop = vault.edge_view(edges).unionByName(vault.edge_view(edges).where("id = 'e2'").withColumn("target", F.col("source")))
    assert {r.node: r.degree for r in vault.degrees(loop).collect()} == {"p": 1, "q": 3, "s": 2}
    assert {r.node: r.degree for r in vault.degrees(loop, loops_twice=False).collect()} == {"p": 1, "q": 2, "s": 2}
    assert {r.node for r in vault.graph_nodes(nodes.where("id <> 'P'").withColumn("type", F.lit("concept")), vault.edge_view(edges)).where("ghost").collect()} == {"p"}


def test_upsert_and_latest(spark):
    old = spark.createDataFrame([("a", 1, J), ("b", 2, J)], "id string, x int, ingested_at timestamp_ntz")
    new = spark.createDataFrame([("b", 3, M), ("c", 4, M)], "id string, x int, ingested_at timestamp_ntz")
    assert {(r.id, r.x) for r in vault.upsert(old, new).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {(r.id, r.x) for r in vault.latest(old.unionByName(new), "x", "ingested_at").collect()} == {("a", 1), ("b", 3), ("c", 4)}


def test_node_search_and_incident(spark):
    rows = [("n1", "Vector Index", "T", None, 5, J), ("n2", "Other", "T", "a vector", 9, J), ("n3", "None", "T", None, 1, J)]
    nodes = spark.createDataFrame(rows, "id string, name string, type string, description string, degree int, ingested_at timestamp_ntz")
    assert [r.id for r in vault.node_search(nodes, "vector", 2).collect()] == ["n2", "n1"]
    view = vault.edge_view(build(spark, False)[1])
    assert ids(vault.incident_edges(view, spark.createDataFrame([("p",), ("s",)], "node string"))) == {"e1", "e2"}


def test_unfenced_regions(spark):
    from quillgraph.functions.text import unfenced

    cases = {"": "", "---": "", "---\na\n---\nb": "b", "\n---\na\n---": "", "a\n ---  \nb": "a", "a\n---\n---\nb\n": "a\nb\n", "a --- b": "a --- b", "---\r\na": "---\r\na", "x\n---": "x"}
    df = spark.createDataFrame([(k, v) for k, v in cases.items()] + [(None, None)], "t string, want string")
    got = df.select("want", unfenced("t").alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_entities_and_topic_of_notes(spark):
    from quillgraph.operators import classify
    from quillgraph.operators.vault_reports import note_entities

    notes = spark.createDataFrame([("N1", "One", "x"), ("n2", None, "y")], "id string, title string, entity_id string")
    nodes = spark.createDataFrame([("e1", "Ada", "PERSON"), ("e2", None, None)], "id string, name string, type string")
    prov = spark.createDataFrame([("e1", "n1_chunk_0"), ("e1", "n1_chunk_1"), ("e2", "n1_chunk_0"), ("e9", "n1_chunk_0"), ("e1", "n7_chunk_0")], "id string, chunk string")
    rows = {tuple(r) for r in note_entities(notes.drop("entity_id"), nodes, prov).collect()}
    assert rows == {("N1", "One", "e1", "Ada", "PERSON"), ("N1", "One", "e2", None, None)}
    assert note_entities(notes.limit(0).drop("entity_id"), nodes, prov).count() == 0
    scores = spark.createDataFrame([(1, "B", 2.0, 50.0), (1, "A", 2.0, 50.0), (2, "C", 1.0, 100.0)], "id int, topic string, score double, percent double")
    assert {tuple(r) for r in classify.leading_topic(scores).collect()} == {(1, "A", 50.0), (2, "C", 100.0)}


def test_repeated_changes_do_not_multiply_rows(spark):
    notes = spark.createDataFrame([("a", "A", "old"), ("b", None, "kept")], "id string, title string, raw_content string")
    changes = spark.createDataFrame([("a", None, "new"), ("a", None, "new"), ("a", None, None), ("z", "Z", "z"), (None, "N", "n")], "id string, title string, raw_content string")
    assert sorted(tuple(r) for r in vault.updated_notes(notes, changes).select("id", "title", "raw_content").collect()) == [("a", "A", "new"), ("b", None, "kept")]
    chunks = spark.createDataFrame([("a_chunk_0", " A ", "x"), ("q", None, "y")], "id string, note_id string, text string")
    assert sorted(tuple(r) for r in vault.updated_chunks(chunks, changes).select("id", "text").collect()) == [("a_chunk_0", "new"), ("q", "y")]
    nodes = spark.createDataFrame([("a", "A", "PERSON", 1.0, 1.0)], "id string, name string, type string, layout_x double, layout_y double")
    layout = spark.createDataFrame([("a", 2.0, 2.0), ("a", 2.0, 2.0), ("m", 0.0, 0.0), ("m", 0.0, 0.0)], "id string, x double, y double")
    assert sorted(tuple(r) for r in vault.placed_nodes(nodes, layout).select("id", "type", "layout_x").collect()) == [("a", "PERSON", 2.0), ("m", "NOTE", 0.0)]
