import heapq
import random
import re
from collections import defaultdict, deque
from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import analytics, communities, components, links, pairs, retrieval, vectors
from quillgraph.plans import catalogue
from quillgraph.session import cut


def view(spark, edges):
    return spark.createDataFrame([(f"e{i}", a, b, "R", 1.0, dt(2024, 1, 1)) for i, (a, b) in enumerate(edges)], "id string, source string, target string, predicate string, weight double, ingested_at timestamp_ntz")


B1 = [("A", "B"), ("B", "E"), ("A", "C"), ("A", "D"), ("D", "E")]


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_pagerank(spark):
    got = {r.node: r["rank"] for r in analytics.pagerank(nodes(spark, "ABCDE"), analytics.simple_digraph(view(spark, B1)), 1e-9).collect()}
    want = {"A": 0.124507, "B": 0.159784, "C": 0.159784, "D": 0.159784, "E": 0.396140}
    assert got == pytest.approx(want, abs=1e-5)
    assert analytics.pagerank(nodes(spark, "").where("false"), view(spark, B1)).count() == 0


def brandes(edges, sources, n):
    """Centrality by the ways from the sources, one after the other."""
    out, c = defaultdict(dict), defaultdict(float)
    for a, b, w in edges:
        if a != b:
            out[a][b] = min(w, out[a].get(b, w))
    for s in sources:
        dist, sigma, preds, order, heap, done = {s: 0}, defaultdict(float, {s: 1.0}), defaultdict(list), [], [(0, s)], set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in done:
                continue
            done.add(v)
            order.append(v)
            for x, w in out[v].items():
                if x not in dist or d + w < dist[x]:
                    dist[x], sigma[x], preds[x] = d + w, sigma[v], [v]
                    heapq.heappush(heap, (d + w, x))
                elif d + w == dist[x]:
                    sigma[x] += sigma[v]
                    preds[x].append(v)
        delta = defaultdict(float)
        for x in reversed(order):
            for v in preds[x]:
                delta[v] += sigma[v] / sigma[x] * (1 + delta[x])
            if x != s:
                c[x] += delta[x]
    return {k: v * n / len(sources) / ((n - 1) * (n - 2)) for k, v in c.items() if v}


def test_betweenness_of_all_and_of_a_sample(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}", rng.choice([1, 2, 3])) for _ in range(70)]
    names = sorted({x for e in edges for x in e[:2]})
    table = spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "source string, target string, weight double")
    every = nodes(spark, names)
    for sources in (every, analytics.pivots(every, 7)):
        own = [r.node for r in sources.collect()]
        got = {r.node: r.centrality for r in analytics.betweenness(table, sources, len(names)).collect()}
        assert got == pytest.approx(brandes(edges, own, len(names)))
    b1 = {r.node: round(r.centrality, 6) for r in analytics.betweenness(analytics.simple_digraph(view(spark, B1)), nodes(spark, "ABCDE"), 5).collect()}
    assert b1 == {"B": 0.041667, "D": 0.041667}


def test_distances(spark):
    rng = random.Random(1)
    edges = [(f"n{rng.randrange(25):02}", f"n{rng.randrange(25):02}") for _ in range(60)]
    names = sorted({x for e in edges for x in e})
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    dist, q = {names[0]: 0}, deque([names[0]])
    while q:
        v = q.popleft()
        for w in near[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                q.append(w)
    got = {r.node: r.hops for r in analytics.distances(view(spark, edges), nodes(spark, names[:1])).collect()}
    assert got == dist


def test_path_ego_hubs(spark):
    v = view(spark, B1)
    assert analytics.shortest_path(v, "B", "C") == ["B", "A", "C"]
    assert analytics.shortest_path(v, "B", "nowhere") == []
    called = spark.createDataFrame([(n, f"Node {n}") for n in "ABCDE"], "node string, name string")
    assert analytics.resolve_node(called, " node b ") == "B" and analytics.resolve_node(called, "d") == "A" and analytics.resolve_node(called, "xyz") is None
    told = analytics.path_narrative(v, called, "Node B", "Node C").first()
    assert (told.found, told.hops, told.narrative) == (True, 2, "Node B --[R]--> Node A --[R]--> Node C")
    assert not analytics.path_narrative(v, called, "xyz", "Node C").first().found
    inside, among = analytics.ego_graph(v, nodes(spark, "A"), 1)
    assert {r.node for r in inside.collect()} == set("ABCD") and among.count() == 3
    assert analytics.density(nodes(spark, "ABCDE"), v).first().density == 0.25
    degree = spark.createDataFrame([("A", 3), ("B", 2), ("C", 1), ("D", 2), ("E", 2)], "node string, degree int")
    central = spark.createDataFrame([("B", 0.5), ("D", 0.5)], "node string, centrality double")
    ranked = analytics.hub_scores(analytics.pagerank(nodes(spark, "ABCDE"), v, 1e-9), degree, central).collect()
    assert [(r.node, r.score) for r in ranked] == [("B", 0.645), ("D", 0.645), ("E", 0.633), ("A", 0.476), ("C", 0.278)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {v: find(v) for v in parent}
    assert components.connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_communities_find_planted_groups(spark):
    rng = random.Random(5)
    edges = []
    for g in range(4):
        own = [f"g{g}n{i:02}" for i in range(15)]
        edges += [tuple(rng.sample(own, 2)) for _ in range(80)]
    edges += [(f"g{rng.randrange(4)}n{rng.randrange(15):02}", f"g{rng.randrange(4)}n{rng.randrange(15):02}") for _ in range(12)]
    pairs = communities.weighted_pairs(view(spark, edges))
    labels = communities.detect(pairs)
    q = communities.modularity(pairs, labels).first()
    planted = labels.select("node", F.substring("node", 1, 2).alias("community"))
    assert q.modularity > 0.85 * communities.modularity(pairs, planted).first().modularity
    assert labels.count() == pairs.select(F.explode(F.array("u", "v")).alias("n")).distinct().count()


def test_moves_over_lists_equal_moves_by_joins(spark, monkeypatch):
    """Labels sent to lists of edges give the same moves as joins, and no edge is shuffled in a round."""
    rng = random.Random(9)
    rows = [(f"n{i:02}", f"n{j:02}", rng.choice([0.5, 1.0, 2.0])) for i in range(60) for j in range(i, 60) if rng.random() < (0.5 if i % 4 == j % 4 else 0.04)] + [("x", "x", 1.0)]
    pairs = spark.createDataFrame(rows, "u string, v string, w double")
    jobs = []
    plain, listed = communities.cut, {r.node: r.community for r in communities.move_nodes(pairs).collect()}
    monkeypatch.setattr(communities, "cut", lambda df, label="cut": jobs.append(label) or plain(df, label))
    communities.move_nodes(pairs)
    assert jobs.count("cm") == 1
    monkeypatch.setattr(communities, "BROADCAST_KEYS", 3)
    assert listed == {r.node: r.community for r in communities.move_nodes(pairs).collect()} and len(set(listed.values())) < 20


@pytest.mark.parametrize("block", [1, 3, 100])
def test_pairs_within_groups(spark, block):
    held = spark.createDataFrame([("x", f"n{i}") for i in range(12)] + [("y", "n1"), ("y", "n2"), ("z", "n3"), (None, "n4")], "entity string, note string")
    got = [tuple(r) for r in pairs.pairs_within(held, ["entity"], "note", block).collect()]
    names = sorted(f"n{i}" for i in range(12))
    want = {("x", a, b) for i, a in enumerate(names) for b in names[i + 1 :]} | {("y", "n1", "n2")}
    assert len(got) == len(want) and set(got) == want


def test_links_of_all_stages(spark):
    text = "zebra quartz marmalade saxophone"
    notes = spark.createDataFrame(
        [("a", "Alpha", "v/alpha.md", "see [[Beta Two|b]] and [[nowhere]]"), ("b", "Beta Two", "v/beta.md", "on graph-theory, briefly"), ("c", "Gamma", "v/c.md", text), ("d", "Gamma", "v/d.md", text + " zebra"), ("e", "Eps", None, "Graph Theory!"), ("f", None, "v/f.md", None)],
        "id string, title string, source_file string, raw_content string",
    )
    assert {tuple(r) for r in links.explicit_links(notes).collect()} == {("a", "b")}
    nodes = spark.createDataFrame([("N1", "graph theory"), ("N2", "Saxo"), ("N3", "see"), ("N4", None), ("N5", "untitled 3"), ("N6", "marmalade")], "id string, name string")
    assert {tuple(r) for r in links.mentions(nodes, notes).collect()} == {("n1", "e"), ("n6", "c"), ("n6", "d")}
    edges = spark.createDataFrame([("n1", "n6", 1.0, False), ("A", "c", 2.0, True), ("c", "a", 3.0, True)], "source string, target string, weight double, weighted boolean").select(F.lower("source").alias("source"), "target", "weight", "weighted")
    stored = links.stored_links(edges, notes)
    assert [tuple(r) for r in stored.collect()] == [("a", "c", 3.0)]
    held = links.mentions(nodes, notes)
    related = links.relation_links(edges, held)
    assert {tuple(r) for r in related.collect()} == {("c", "e", 0.8), ("d", "e", 0.8)}
    similar = links.similar_pairs(links.term_vectors(notes.select("id", F.concat_ws(" ", "title", "raw_content").alias("text")), "id", "text"))
    assert [(r.a, r.b) for r in similar.collect()] == [("c", "d")]
    graph = links.note_graph(links.explicit_links(notes), stored, links.shared_entity_links(held), related, similar)
    assert {(r.a, r.b): r.stage for r in graph.collect()} == {("a", "b"): 1, ("a", "c"): 2, ("c", "d"): 3, ("c", "e"): 4, ("d", "e"): 4}
    assert {r.note: r.degree for r in links.note_degrees(notes, graph).collect()} == {"a": 2, "b": 1, "c": 3, "d": 2, "e": 2, "f": 0}
    assert {(r.note, r["class"]) for r in links.shared_entity_classes(held).collect()} == {("c", "c"), ("d", "c"), ("e", "e")}


def test_linked_counts_equal_counts_of_pairs(spark, monkeypatch):
    """Similar pairs and others, some of them both, over several blocks: each counts once, for both ends."""
    monkeypatch.setattr(links, "LEAST_ROWS", 16)
    rng = random.Random(22)
    texts = spark.createDataFrame([(f"t{i}", None if i % 13 == 0 else " ".join(rng.choices(f"a{i % 5} b{i % 5} c{i % 5} x y z".split(), k=9))) for i in range(90)], "id string, text string")
    similar = {(r.a, r.b) for r in links.similar_texts(texts, "id", "text").collect()}
    some = [tuple(rng.sample(range(90), 2)) for _ in range(150)]
    others = [(f"t{i}", f"t{j}") for i, j in some] + [(b, a) for a, b in sorted(similar)[:40]] + [("t3", "t3"), ("t0", "t13")]
    want = {}
    for a, b in similar | {(min(x), max(x)) for x in others if x[0] != x[1]}:
        want[a], want[b] = want.get(a, 0) + 1, want.get(b, 0) + 1
    counts = links.linked_counts(texts, "id", "text", spark.createDataFrame(others, "a string, b string"))
    assert len(similar) > 100 and {r.note: r.n for r in counts.collect()} == want
    monkeypatch.setattr(links, "BROADCAST_KEYS", 3)
    assert {r.note: r.n for r in links.linked_counts(texts, "id", "text", spark.createDataFrame(others, "a string, b string")).collect()} == want
    none = spark.createDataFrame([], "a string, b string")
    stats = links.graph_stats(texts, links.linked_counts(texts.where("id = 'x'"), "id", "text", none)).first()
    assert (stats.notes, stats.links, stats.avg_degree) == (90, 0, 0.0)


def test_mentions_equal_a_plain_search(spark):
    rng = random.Random(21)
    words = ["graph", "node", "edge", "map", "α1"]
    names = [sep.join(rng.choices(words, k=k)) for k in (1, 2, 3, 4, 5) for sep in (" ", "-", ", ") for _ in range(6)]
    names += ["====", "(graph)", "c++ node", ".node edge map graph", "graph node edge map graph.", "Edge  Map", "no such word", "nograph", "gra", None]
    nodes = spark.createDataFrame([(f"N{i}", n) for i, n in enumerate(names)], "id string, name string")
    texts = [rng.choice(["", ". ", "("]).join([" ".join(rng.choices(words, k=4)), "-".join(rng.choices(words, k=3)), ", ".join(rng.choices(words, k=5))]) for _ in range(40)]
    texts += ["a ==== b", "see (Graph).", "use C++ Node", "a.node edge map graph", "x .node edge map graph", "nographs", None]
    notes = spark.createDataFrame([(f"t{i}", None, x) for i, x in enumerate(texts)], "id string, title string, raw_content string")
    mark = lambda x: re.sub(r"\w+", "\1\\g<0>\1", x.lower())
    want = {(f"n{i}", f"t{j}") for i, n in enumerate(names) if n and len(n) >= 4 for j, x in enumerate(texts) if mark(n) in mark(" " + (x or ""))}
    got = [tuple(r) for r in links.mentions(nodes, notes).collect()]
    assert set(got) == want and len(got) == len(want) > 200 and {("n90", f"t{len(texts) - 7}"), ("n93", f"t{len(texts) - 3}")} <= want


def test_similar_pairs_are_exact(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(60)]
    texts += [t + " " + rng.choice(words) for t in texts[:30]]
    rows = cut(links.term_vectors(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text"))
    vectors = defaultdict(dict)
    for r in rows.collect():
        vectors[r.id][r.term] = r.w
    want = {(a, b) for a in vectors for b in vectors if a < b and sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items()) >= 0.7}
    assert {(r.a, r.b) for r in links.similar_pairs(rows).collect()} == want and len(want) > 20


def test_similar_texts_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(links, "LEAST_ROWS", 16)
    monkeypatch.setattr(links, "MOST_CELLS", 100)
    rng = random.Random(10)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=12)) for _ in range(60)] + ["every", "", None]
    rows = [(f"n{i:02}", x) for i, x in enumerate(texts + [f"{t} {rng.choice(words)}" for t in texts[:30]])] + [("n05", "w1 w2 w3 w3"), (None, "w1")]
    df = spark.createDataFrame(rows, "id string, text string")
    vectors = defaultdict(dict)
    for r in links.term_vectors(df, "id", "text").collect():
        vectors[r.id][r.term] = r.w
    dot = lambda a, b: sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items())
    want = {(a, b): dot(a, b) for a in vectors for b in vectors if a < b and dot(a, b) >= 0.7}
    for dense in (0.0, 0.05, 2.0):
        monkeypatch.setattr(links, "DENSE", dense)
        got = links.similar_texts(df, "id", "text").collect()
        assert {(r.a, r.b): pytest.approx(r.similarity) for r in got} == want and len(got) == len(want) > 20
    assert links.similar_texts(df.where("id IS NULL"), "id", "text").count() == 0


def test_rank_fusion(spark):
    make = lambda rows: spark.createDataFrame(rows, "chunk string, score double")
    got = retrieval.reciprocal_rank_fusion([(make([("x", 2.0), ("y", 1.0)]), 0.5), (make([("y", 2.0), ("z", 1.0)]), 0.5), (make([("z", 1.0)]), 0.5)], 3).collect()
    assert [r.chunk for r in got] == ["y", "z", "x"] and got[0].score == pytest.approx(0.5 / 62 + 0.5 / 61)


def test_modes_and_scores(spark):
    df = spark.createDataFrame([(1, "Give an overview of it"), (2, "What are the main themes?"), (3, "Who is Alice?"), (4, None)], "i int, q string")
    assert [r.m for r in df.select("i", retrieval.mode("q").alias("m")).orderBy("i").collect()] == ["global", "global", "local", "local"]
    assert df.where("i = 3").select(retrieval.keyword_grams("q").alias("g")).first().g == ["Alice"]
    rows = spark.createDataFrame([(1, "what is spark sql", "spark sql is a module")], "id int, question string, answer string")
    contexts = spark.createDataFrame([(1, "spark sql module"), (1, "unrelated text here")], "id int, context string")
    r = retrieval.answer_scores(rows, contexts).first()
    assert (r.context_precision, r.faithfulness, r.answer_relevance, r.overall) == (0.5, 0.857, 1.0, 0.793)


def test_vector_search(spark):
    import numpy as np

    x = np.random.default_rng(0).standard_normal((300, 16)).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>").repartition(5)
    got = vectors.search(df, df.where("vec_id % 50 = 0"), 4).collect()
    s = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(s, -np.inf)
    want = {(q, int(v), k + 1) for q in range(0, 300, 50) for k, v in enumerate(np.argsort(-s[q])[:4])}
    assert {(r.query_id, r.vec_id, r["rank"]) for r in got} == want
    one = vectors.mean_pair_similarity(df.withColumn("g", F.lit(1)), "g").first()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert one.mean_cosine == pytest.approx((u @ u.T)[np.triu_indices(300, 1)].mean(), abs=1e-4)


def test_catalogue():
    assert set(catalogue.ORACLE) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 60


def test_moves_of_nodes_with_loops_without_weight_and_without_rows(spark):
    def moved(rows):
        pairs = spark.createDataFrame(rows, "u string, v string, w double")
        return dict(map(tuple, communities.move_nodes(pairs, 5).collect()))

    assert moved([]) == {}
    assert moved([("a", "a", 1.0)]) == {"a": "a"}
    assert moved([("a", "b", 0.0)]) == {"a": "a", "b": "b"}
    found = moved([("a", "b", 1.0), ("c", "d", 2.0), ("a", "a", 1.0)])
    assert found["a"] == found["b"] != found["c"] == found["d"]


@pytest.mark.parametrize("query, want", [("relation_bridge_links", {("t1", "t2", 0.5), ("t1", "t3", 0.5), ("t2", "t3", 0.5)}), ("shared_entity_links", {("t1", "t3", 1), ("t2", "t3", 1)})])
def test_notes_of_entities_are_found_once(spark, tmp_path, query, want):
    """What joins the notes of entities with themselves reads them from a table and no text anew."""
    at = dt(2024, 1, 1)
    tables = {
        "notes": ([("t1", "One", "on graph theory", None, at), ("t2", "Two", "x", None, at), ("t3", "Graph Theory", "y", None, at)], "id string, title string, raw_content string, deleted_at timestamp, ingested_at timestamp"),
        "chunks": ([("t2_chunk_0", "t2", "x", at), ("t3_chunk_0", "t3", "y", at)], "id string, note_id string, text string, ingested_at timestamp"),
        "nodes": ([("n1", "graph theory", "[]", at), ("n2", "nowhere", '["t2_chunk_0", "t3_chunk_0"]', at)], "id string, name string, provenance string, ingested_at timestamp"),
        "edges": ([("e1", "n1", "n2", "R", 0.5, 1.0, "[]", at)], "id string, source string, target string, predicate string, weight double, confidence double, provenance string, ingested_at timestamp"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = catalogue.QUERIES[query](spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == want
    assert "raw_content" not in got._jdf.queryExecution().optimizedPlan().toString()
