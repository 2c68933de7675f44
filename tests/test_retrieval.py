import math
from collections import Counter
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.stem import folded, stem, stems
from quillgraph.operators import classify, communities, embeddings, extraction, lexical, retrieval, vault, vault_reports

J, M = dt(2024, 1, 5), dt(2024, 3, 5)


def test_named_nodes(spark):
    rows = [("n1", "Spark", "T", "engine", 5), ("n2", "Sparkling water", "C", None, 9), ("n3", "River", "C", "a spark of joy", 1), ("n4", "Graph Index", "T", "", None), ("n5", None, None, None, 3), ("n6", "", "C", None, 8), ("n7", "Vector", "T", "x", 2)]
    nodes = spark.createDataFrame(rows, "id string, name string, type string, description string, degree int")
    got = [(r.id, r.place) for r in retrieval.named_nodes(nodes, ["vector", "spark"], "What is a graph index for?", 10).orderBy("place").collect()]
    assert got == [("n7", 1), ("n2", 2), ("n1", 3), ("n3", 4), ("n4", 5)]
    assert [r.id for r in retrieval.named_nodes(nodes, ["spark"], "graph index", 2).orderBy("place").collect()] == ["n2", "n1"]
    assert retrieval.named_nodes(nodes, [], "nothing", 5).count() == 0
    cited = retrieval.entity_citations(retrieval.named_nodes(nodes, ["spark"], "", 5), 2).orderBy("id").collect()
    assert [(r.id, r.snippet) for r in cited] == [("n1", "engine"), ("n2", "Entity: Sparkling water (C)")]


def test_cosine(spark):
    texts = ["graph graph vector", "nothing here", None, "", "Vector; index of a GRAPH?"]
    question = "graph vector graph"
    got = [r.c for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", lexical.cosine(question, "t").alias("c")).orderBy("i").collect()]
    q = Counter(question.split())

    def brute(text):
        c = Counter("".join(ch if ch.isalnum() else " " for ch in (text or "").lower()).split())
        size = math.sqrt(sum(n * n for n in c.values()) * sum(n * n for n in q.values()))
        return sum(n * c[t] for t, n in q.items()) / size if size else 0.0

    assert got == pytest.approx([brute(t) for t in texts])


def test_community_scores_with_a_question(spark):
    comm = spark.createDataFrame([(1, "Graph", "vector index", '["a"]'), (2, None, None, None), (3, "x", "index index", "no list")], "id bigint, name string, summary string, themes string")
    got = {r.id: r.score for r in retrieval.community_scores(comm, ["graph"], ["index"], "index").collect()}
    assert got == pytest.approx({1: 2.5 + 3 / math.sqrt(2), 2: 0.0, 3: 3.5})


def test_agreement_and_context(spark):
    one, two = (spark.createDataFrame([(c,) for c in s], "chunk string") for s in ("abc", "bcd"))
    assert tuple(retrieval.agreement(one, two).first()) == (3, 3, 2, 0.5)
    assert tuple(retrieval.agreement(one.limit(0), two.limit(0)).first()) == (0, 0, 0, 0.0)
    matched = spark.createDataFrame([("n1", "Spark", "T", "engine", 5, 1)], "id string, name string, type string, description string, degree bigint, place bigint")
    relations = spark.createDataFrame([("e1", "a", "R", "b")], "id string, source string, predicate string, target string")
    comm = spark.createDataFrame([(1, "C", None)], "rank bigint, name string, summary string")
    cited = spark.createDataFrame([("c1", "T1", "s1", 0.5), ("c2", "T2", "s2", 0.9)], "chunk string, title string, snippet string, score double")
    assert retrieval.context_block(matched, relations, comm, cited).first().context == "Entities: Spark (T)\nRelations: a R b\nCommunities: C: \nExcerpts:\n[T2]: s2\n[T1]: s1"
    assert retrieval.context_block(matched.limit(0), relations.limit(0), comm.limit(0), cited.limit(0)).first().context == ""


@pytest.fixture(scope="module")
def stored(spark):
    notes = spark.createDataFrame([("note1", "A", None, J, M), ("note2", "B", "text", J, None)], "id string, title string, raw_content string, ingested_at timestamp_ntz, deleted_at timestamp_ntz")
    chunks = spark.createDataFrame([("c1", " NOTE1", "one", J), ("c2", "note2", "two", J)], "id string, note_id string, text string, ingested_at timestamp_ntz")
    nodes = spark.createDataFrame([("P", '["c1"]', J), ("Q", '["c2"]', J), ("S", "['c1', 'c2']", J), ("G", None, J)], "id string, provenance string, ingested_at timestamp_ntz")
    edges = spark.createDataFrame([("e1", "P", "S", "R", 1.0, None, '["c1"]', J), ("e2", "Q", "S", "R", None, None, '["c2"]', J), ("e3", "S", "S", "R", 1.0, None, "[]", J), ("e4", "ghost", "Q", "R", 1.0, None, "[]", J), ("e5", "Q", "G", "R", 1.0, None, '["c1"]', J)], "id string, source string, target string, predicate string, weight double, confidence double, provenance string, ingested_at timestamp_ntz")
    comm = spark.createDataFrame([(1, 0, None, '["P", "Q", "S"]'), (2, 0, None, '["P"]'), (3, 0, None, None)], "id bigint, level int, parent_id bigint, node_ids string")
    return nodes, edges, comm, chunks, notes


def test_purge(stored, spark):
    left = vault.purge(*stored)
    assert [r.id for r in left["notes"].collect()] == ["note2"] and [r.id for r in left["chunks"].collect()] == ["c2"]
    assert {(r.id, r.provenance, r.degree) for r in left["nodes"].collect()} == {("Q", '["c2"]', 2), ("S", '["c2"]', 2), ("G", "[]", 0)}
    assert {(r.id, r.source, r.target, r.provenance) for r in left["edges"].collect()} == {("e2", "q", "s", '["c2"]'), ("e3", "s", "s", "[]"), ("e4", "ghost", "q", "[]")}
    assert {(r.id, r.node_ids) for r in left["communities"].collect()} == {(1, '["q","s"]')}
    assert {r.what: r.n for r in vault.purge_counts(*stored).collect()} == {"notes": 1, "chunks": 1, "nodes": 1, "edges": 2, "communities": 2}
    empty = [df.limit(0) for df in stored]
    assert all(df.count() == 0 for df in vault.purge(*empty).values())


def test_changes_of_notes_and_layout(stored, spark):
    nodes, _, _, chunks, notes = stored
    change = spark.createDataFrame([("note1", None, "new"), ("note2", "T", None)], "id string, title string, raw_content string")
    assert {(r.id, r.title, r.raw_content) for r in vault.updated_notes(notes, change).collect()} == {("note1", "A", "new"), ("note2", "T", "text")}
    assert {(r.id, r.text) for r in vault.updated_chunks(chunks, change).collect()} == {("c1", "new"), ("c2", "two")}
    placed = vault.placed_nodes(nodes.withColumns({"name": F.col("id"), "type": F.lit("C"), "layout_x": F.lit(0.0), "layout_y": F.lit(0.0)}), spark.createDataFrame([("P", 3.0, 4.0), ("new", 1.0, 2.0)], "id string, x double, y double"))
    assert {(r.id, r.type, r.layout_x) for r in placed.collect()} == {("P", "C", 3.0), ("Q", "C", 0.0), ("S", "C", 0.0), ("G", "C", 0.0), ("new", "NOTE", 1.0)}
    assert [r.id for r in vault.rows_of(notes, spark.createDataFrame([(" NOTE2 ",), (None,)], "id string")).collect()] == ["note2"]


def test_latest_texts(spark):
    rows = [("a", "old", J), ("a", "new", M), ("b", "one", None), ("c", "x", J), ("c", "y", J), (None, "z", J)]
    df = spark.createDataFrame(rows, "id string, text string, ingested_at timestamp_ntz")
    got = {(r.id, r.text) for r in vault.latest_texts(df, "text", "ingested_at").collect()}
    assert got == {("a", "new"), ("b", "one"), ("c", "y")} == {(r.id, r.text) for r in vault.latest(df, "text", "ingested_at").collect()}
    assert vault.latest_texts(df.limit(0), "text", "ingested_at").count() == 0


def test_merged_nodes_and_relations(spark):
    nodes = spark.createDataFrame([("n1", "Fast API", "T", "abc", 1), ("n2", "fast  api!", "C", "abcd", None), ("n3", "FAST API", "C", "wxyz", 7), ("n4", "--", "C", "d", 1), ("n5", None, None, None, None)], "id string, name string, type string, description string, degree int")
    got = {r.key: (r.name, r.type, r.description, r.degree, r.n) for r in extraction.merged_nodes(nodes).collect()}
    assert got["fast api"] == ("Fast API", "T", "abcd", 7, 3)
    entities = spark.createDataFrame([("c1", 1, "Fast API", "T", 0.8), ("c1", 2, "fast api!", "T", 0.8), ("c2", 1, "Graph", "C", 0.8)], "chunk_id string, ord bigint, name string, type string, confidence double")
    relations = spark.createDataFrame([("c1", 1, "fast api!", "uses", "Graph"), ("c2", 1, "Fast API", "USES", "GRAPH"), ("c2", 2, "FAST  api", "is", "Fast API"), ("c2", 3, " other ", "is", "graph")], "chunk_id string, ord bigint, subject string, predicate string, object string")
    got = {tuple(r) for r in extraction.canonical_relations(entities, relations).collect()}
    assert got == {("Fast API", "USES", "Graph", 2), ("other", "IS", "Graph", 1)}


def test_matched_words_and_tags(spark):
    docs = spark.createDataFrame([(1, "The contract and the agreement on cash flow, revenue: an urgent success. Governing law!"), (2, ""), (3, None), (4, "nothing")], "i int, t string")
    scores = classify.topic_scores(docs, "i", "t")
    got = {(r.id, r.topic): r.matched for r in scores.collect()}
    assert got == {(1, "Legal"): "agreement, contract, governing law", (1, "Financial"): "revenue, cash flow", (2, "General"): "", (4, "General"): ""}
    tags = {r.id: r.tags for r in classify.auto_tags(scores, classify.tone(docs, "i", "t")).collect()}
    assert tags == {1: "legal financial sentiment_positive prio_urgent agreement contract revenue cash_flow", 2: "general sentiment_neutral prio_medium", 4: "general sentiment_neutral prio_medium"}


@pytest.mark.parametrize(
    ("word", "want"),
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("digitizer", "digit"), ("sensibiliti", "sensibl"), ("electrical", "electr"), ("adjustable", "adjust"), ("adoption", "adopt"), ("controll", "control"), ("rate", "rate"), ("is", "is"), ("граф", "граф")],
)
def test_stem(word, want):
    assert stem(word) == want


def test_search_by_stems(spark):
    assert folded("Éclair ÀÉ") == "eclair ae" and stems("Running queries, ÉTUDES") == ["run", "queri", "etud"] and stems(None) == []
    rows = [("a", "The graphs of querying"), ("b", "one graph"), ("c", "query GRAPHÉ graph"), ("d", None), (None, "graph query"), *((f"x{i}", "filler words") for i in range(9))]
    chunks = spark.createDataFrame(rows, "id string, text string")
    got = {r.chunk_id for r in lexical.bm25(chunks, ["graph", "queries"], stemmed=True).collect()}
    assert got == {"a", "c"}


def test_word_vectors(spark):
    texts = spark.createDataFrame([(i, "red apple fruit sweet" if i % 2 else "fast car engine road") for i in range(60)] + [(100, None), (101, "unheard")], "id int, text string")
    tokens = embeddings.tokenised(texts, "id", "text")
    got = {r.id: r.v for r in embeddings.mean_vectors(tokens, embeddings.word_vectors(tokens, size=8, least=2)).collect()}
    assert got[1] == got[3] and got[0] != got[1] and not any(got[100]) and not any(got[101])
    assert math.fsum(x * x for x in got[0]) == pytest.approx(1, abs=1e-5)
    named = spark.createDataFrame([("a", "N", "d"), ("b", "N", " "), ("c", "N", None), ("d", None, "d")], "id string, name string, description string")
    assert {tuple(r) for r in embeddings.node_texts(named).collect()} == {("a", "N: d"), ("b", "N"), ("c", "N")}


def test_built_graph(spark):
    chunks = spark.createDataFrame([("c1", "Ada Lovelace met Charles Babbage."), ("c2", "**Ada Lovelace** wrote."), ("c3", None)], "id string, text string")
    nodes, edges = extraction.built_graph(chunks)
    assert {(r.key, r.n_chunks, r.degree) for r in nodes.collect()} == {("ada lovelace", 2, 1), ("charles babbage", 1, 1)}
    assert [tuple(r) for r in edges.collect()] == [("Ada Lovelace", "RELATES_TO", "Charles Babbage", 1)]


def test_community_table(spark):
    nodes = spark.createDataFrame([(f"n{i}",) for i in range(6)], "node string")
    labels = spark.createDataFrame([(f"n{i}", "n0" if i < 5 else "n5") for i in range(6)], "node string, community string")
    parts = labels.withColumn("part", F.when(F.col("node").isin("n3", "n4"), "n3").otherwise(F.col("community")))
    got = {(r.id, r.level, r.parent_id, r.name, r["size"]) for r in communities.community_table(nodes, labels, parts).collect()}
    assert got == {("n0", 0, None, "n0, n1, n2", 5), ("n5", 0, None, "n5", 1), ("n0/1", 1, "n0", "n0, n1, n2", 3), ("n3/1", 1, "n0", "n3, n4", 2)}
    general = communities.community_table(nodes, labels.limit(0), parts.limit(0)).collect()
    assert [(r.name, r["size"]) for r in general] == [("General Community", 6)]
    assert communities.community_table(nodes.limit(0), labels.limit(0), parts.limit(0)).count() == 0
    stored = spark.createDataFrame([(1, "a", "old", "t", 0.5), (2, "b", None, None, None)], "id bigint, name string, summary string, themes string, confidence double")
    new = spark.createDataFrame([(2, "x", "s")], "community bigint, themes string, summary string")
    assert {tuple(r) for r in communities.with_summaries(stored, new).select("id", "summary", "themes").collect()} == {(1, "old", "t"), (2, "s", "x")}


def test_exports(spark):
    pts = spark.createDataFrame([("a", 0.0, 0.0), ("b", 3.0, 4.0), ("c", 0.0, 5.0), ("d", None, 1.0)], "id string, layout_x double, layout_y double")
    assert [tuple(r) for r in vault_reports.nearest(pts, pts.where("id = 'a'"), 10.0).collect()] == [("a", "b", 5.0)]
    turns = spark.createDataFrame([("s1", 1), ("s2", 2)], "session string, n int")
    assert [r.session for r in vault_reports.cleared(turns, turns.where("session = 's1'"), "session").collect()] == ["s2"]
    notes = spark.createDataFrame([("n", "é"), ("m", None)], "id string, raw_content string")
    assert {tuple(r) for r in vault_reports.exported_notes(notes).collect()} == {("n.md", "é", 2), ("m.md", "", 0)}
