"""Graph analytics: density, PageRank, paths, neighbourhoods, betweenness, hub scores, questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import cut, drop_cut

DAMPING = 0.85


def simple_digraph(view: DataFrame) -> DataFrame:
    """``(source, target, weight)``: parallel edges as one, the latest edge's weight counts; loops stay."""
    return view.where("source IS NOT NULL AND target IS NOT NULL").groupBy("source", "target").agg(F.max_by("weight", F.struct("ingested_at", "id")).alias("weight"))


def density(nodes: DataFrame, view: DataFrame) -> DataFrame:
    """``(nodes, edges, density)`` of the directed multigraph."""
    both = nodes.agg(F.count("*").alias("nodes")).crossJoin(view.agg(F.count("*").alias("edges")))  # one row each
    n = F.col("nodes")
    return both.select("nodes", "edges", F.round(F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(0.0), 6).alias("density"))


def top_relations(view: DataFrame, k: int = 6) -> DataFrame:
    """The most frequent predicates."""
    return view.groupBy("predicate").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "predicate").limit(k)


def pagerank(nodes: DataFrame, edges: DataFrame, tolerance: float = 1e-6, most: int = 201, every: int = 3) -> DataFrame:
    """``(node, rank)``, adding up to 1: weights share out a node's rank, dangling nodes share with all.

    What dangling nodes give to all raises every rank by the same, so it is left out of the rounds and made up for by the
    scale at the end.  Each round is one join on the source and one combined sum by target, so a target that holds much of
    the edges is added up before the shuffle.  Every few rounds the ranks are cut, and the rounds end when the last one
    changed them by less than the tolerance times the number of nodes in all.
    """
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    out = edges.groupBy("source").agg(F.sum("weight").alias("total")).where("total > 0")
    shares = cut(edges.join(out, "source").select("source", "target", (F.col("weight") / F.col("total")).alias("share")), "pr-edges")
    base = cut(nodes.select("node").distinct(), "pr-nodes")
    ranks = cut(base.select("node", F.lit(1.0 / n).alias("rank"), F.lit(0.0).alias("before")), "pr")
    for turn in range(1, most + 1):
        came = shares.join(ranks.select(F.col("node").alias("source"), "rank"), "source").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("came"))
        now = (F.lit((1 - DAMPING) / n) + DAMPING * F.coalesce("came", F.lit(0.0))).alias("rank")
        if turn % every:
            ranks = base.join(came, "node", "left").select("node", now)
            continue
        held = ranks.select("node", F.col("rank").alias("before"))
        fresh = cut(held.join(came, "node", "left").select("node", now, "before"), "pr")
        ranks = fresh
        if fresh.agg(F.sum(F.abs(F.col("rank") - F.col("before")))).first()[0] < tolerance * n:
            break
    total = ranks.agg(F.sum("rank").alias("total"))
    return ranks.crossJoin(F.broadcast(total)).select("node", (F.col("rank") / F.col("total")).alias("rank"))  # one row


def undirected(edges: DataFrame) -> DataFrame:
    """``(u, v)`` in both directions, without loops, each once."""
    pairs = edges.where("source <> target").select(F.explode(F.array(F.struct(F.col("source").alias("u"), F.col("target").alias("v")), F.struct(F.col("target").alias("u"), F.col("source").alias("v")))).alias("e"))
    return pairs.select("e.u", "e.v").distinct()


def distances(edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """``(source, node, hops)`` of all nodes that can be reached from each source (column ``node``), or of those within
    ``most`` hops; ways go both ways."""
    near = cut(undirected(edges), "bfs-edges")
    seen = cut(sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("hops")).distinct(), "bfs")
    edge, hop = seen, 0
    while most is None or hop < most:
        hop += 1
        step = edge.join(near.withColumnRenamed("u", "node"), "node").select("source", F.col("v").alias("node")).distinct()
        edge = cut(step.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(hop)), "bfs")
        if edge.isEmpty():
            break
        seen = seen.unionByName(edge)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str) -> list[str]:
    """The nodes of a shortest way; of equally short ones the first in the order of node keys.  Empty where none is."""
    spark = edges.sparkSession
    from_end = distances(edges, spark.createDataFrame([(end,)], "node string")).select("node", "hops")
    near = cut(undirected(edges), "path-edges")
    here = from_end.where(F.col("node") == start).first()
    if here is None:
        return []
    path = [start]
    for hop in range(here["hops"] - 1, -1, -1):
        nxt = near.where(F.col("u") == path[-1]).select(F.col("v").alias("node")).join(from_end.where(F.col("hops") == hop), "node").agg(F.min("node")).first()[0]
        path.append(nxt)
    return path


def resolve_node(nodes: DataFrame, asked: str) -> str | None:
    """The key of the node ``(node, name)`` that a word names: its key or name in any case, else the first by key whose
    name holds the word or is held in it; None where there is none."""
    q = asked.strip().lower()
    name = F.lower(F.trim("name"))
    exact = (F.col("node") == q) | (name == q)
    rows = nodes.where(exact | name.contains(q) | ((name != "") & F.lit(q).contains(name)))
    found = rows.select("node", F.when(exact, 0).otherwise(1).alias("k")).orderBy("k", "node").first()
    return found["node"] if found else None


def path_narrative(view: DataFrame, nodes: DataFrame, start: str, end: str) -> DataFrame:
    """``(source, target, found, hops, narrative)``: one row with a shortest way between two named nodes in words.

    ``nodes``: ``(node, name)``.  Of parallel relations the one of the smallest id is told, and one that goes along the way
    rather than against it.  Only the nodes of the way, not the graph, are gathered.
    """
    spark = view.sparkSession
    kinds = "source string, target string, found boolean, hops bigint, narrative string"
    a, b = resolve_node(nodes, start), resolve_node(nodes, end)
    if not a or not b:
        return spark.createDataFrame([(start, end, False, None, f"Nothing in the graph is named '{end if a else start}'.")], kinds)
    path = shortest_path(view, a, b)
    if not path:
        return spark.createDataFrame([(start, end, False, None, f"No way leads from '{start}' to '{end}'.")], kinds)
    steps = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(zip(path, [*path[1:], None]))], "i int, u string, v string")
    of = F.broadcast(steps)  # as many rows as the way has nodes
    along = view.join(of, (F.col("source") == F.col("u")) & (F.col("target") == F.col("v"))).select("i", F.lit(0).alias("back"), "id", "predicate")
    against = view.join(of, (F.col("source") == F.col("v")) & (F.col("target") == F.col("u"))).select("i", F.lit(1).alias("back"), "id", "predicate")
    told = along.unionByName(against).groupBy("i").agg(F.min_by("predicate", F.struct("back", "id")).alias("predicate"))
    named = nodes.join(F.broadcast(steps.select(F.col("u").alias("node"), "i")), "node").groupBy("i").agg(F.min("name").alias("name"))
    rows = steps.join(named, "i", "left").join(told.select((F.col("i") + 1).alias("i"), "predicate"), "i", "left")
    part = F.concat(F.when(F.col("i") > 0, F.concat(F.lit(" --["), F.coalesce("predicate", F.lit("CONNECTED_TO")), F.lit("]--> "))).otherwise(""), F.coalesce("name", "u"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", part.alias("t")))), lambda x: x["t"]), "")
    return rows.agg((F.count("*") - 1).alias("hops"), line.alias("narrative")).select(F.lit(start).alias("source"), F.lit(end).alias("target"), F.lit(True).alias("found"), "hops", "narrative")


def ego_graph(edges: DataFrame, seeds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """``(node, hops)`` around the seeds, and the directed edges among those nodes."""
    inside = distances(edges, seeds, depth).groupBy("node").agg(F.min("hops").alias("hops"))
    keep = inside.select("node")
    among = edges.join(keep.withColumnRenamed("node", "source"), "source", "left_semi").join(keep.withColumnRenamed("node", "target"), "target", "left_semi")
    return inside, among


def pivots(nodes: DataFrame, k: int) -> DataFrame:
    """``(node)``: a sample of ``k`` nodes for estimates, drawn by a hash of their keys."""
    return nodes.select("node").distinct().orderBy(F.xxhash64("node"), "node").limit(k)


def betweenness(edges: DataFrame, sources: DataFrame, n_nodes: int) -> DataFrame:
    """``(node, centrality)``: the share of shortest directed ways that pass a node, weights being lengths.

    ``sources`` are all nodes, or a sample of them (:func:`pivots`) for an estimate; the sums are divided by
    (n - 1)(n - 2) for all of ``n_nodes`` and scaled up by the part of them that is a source.  All sources advance
    together: lengths are relaxed until none gets shorter, then the numbers of ways go forward and the shares go back along
    the edges of shortest ways.  Each step is a join on source and node and a sum.  Weights are read in millionths, so that
    equally long ways are equal; nodes on no way between others are left out.
    """
    steps = cut(edges.where("source <> target").groupBy("source", "target").agg(F.min(F.round(F.col("weight") * 1e6).cast("bigint")).alias("w")), "bw-edges")
    start = cut(sources.select(F.col("node").alias("s"), "node").distinct(), "bw-sources")
    best = cut(start.withColumn("d", F.lit(0).cast("bigint")), "bw-best")
    front = best
    while True:
        near = front.join(steps.withColumnRenamed("source", "node"), "node").groupBy("s", F.col("target").alias("node")).agg(F.min(F.col("d") + F.col("w")).alias("d"))
        front = cut(near.join(best.withColumnRenamed("d", "old"), ["s", "node"], "left").where("old IS NULL OR d < old").select("s", "node", "d"), "bw-front")
        if front.isEmpty():
            break
        older, best = best, cut(best.unionByName(front).groupBy("s", "node").agg(F.min("d").alias("d")), "bw-best")
        drop_cut(older)
    ways = best.select("s", F.col("node").alias("u"), "d").join(steps.select(F.col("source").alias("u"), F.col("target").alias("v"), "w"), "u")
    ways = cut(ways.join(best.select("s", F.col("node").alias("v"), F.col("d").alias("dv")), ["s", "v"]).where("d + w = dv").select("s", "u", "v"), "bw-ways")

    def spread(level: DataFrame, here: str, there: str) -> DataFrame:
        """``(s, node, x)``: what starts at ``level``, added up along all ways from there."""
        total = level
        while True:
            level = cut(level.withColumnRenamed("node", here).join(ways, ["s", here]).groupBy("s", F.col(there).alias("node")).agg(F.sum("x").alias("x")), "bw-level")
            if level.isEmpty():
                return cut(total.groupBy("s", "node").agg(F.sum("x").alias("x")), "bw-total")
            total = total.unionByName(level)

    number = spread(start.withColumn("x", F.lit(1.0)), "u", "v")
    last = ways.join(number.select("s", F.col("node").alias("v"), "x"), ["s", "v"]).groupBy("s", F.col("u").alias("node")).agg(F.sum(1 / F.col("x")).alias("x"))
    shares = spread(cut(last, "bw-last"), "v", "u")
    scale = n_nodes / max(1, start.count()) / max(1, (n_nodes - 1) * (n_nodes - 2))
    met = shares.where("s <> node").join(number.withColumnRenamed("x", "ways"), ["s", "node"])
    return met.groupBy("node").agg((F.sum(F.col("x") * F.col("ways")) * scale).alias("centrality"))


def hub_scores(ranks: DataFrame, degree: DataFrame, central: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nodes of the highest mix of rank, degree and centrality, each in shares of its maximum."""
    rows = ranks.join(degree, "node", "left").join(central, "node", "left").select("node", "rank", F.coalesce("degree", F.lit(0)).alias("degree"), F.coalesce("centrality", F.lit(0.0)).alias("centrality"))
    most = rows.agg(F.max("rank").alias("mr"), F.max("degree").alias("md"), F.max("centrality").alias("mc"))
    share = lambda c, m: F.when(F.col(m) > 0, F.col(c) / F.col(m)).otherwise(0.0)
    scored = rows.crossJoin(F.broadcast(most)).select("node", "degree", F.round(0.4 * share("rank", "mr") + 0.35 * share("degree", "md") + 0.25 * share("centrality", "mc"), 3).alias("score"))  # one row of maxima
    return scored.orderBy(F.desc("score"), "node").limit(k)


def surprising_connections(view: DataFrame, members: DataFrame, k: int = 8) -> DataFrame:
    """Edges between communities, by the membership of the highest level; community 0 does not count."""
    of = members.groupBy("node").agg(F.max_by("id", F.struct("level", "id")).alias("c"))
    a, b = of.select(F.col("node").alias("source"), F.col("c").alias("c_source")), of.select(F.col("node").alias("target"), F.col("c").alias("c_target"))
    return view.join(a, "source").join(b, "target").where("c_source <> c_target AND c_source <> 0 AND c_target <> 0").select("id", "source", "target", "predicate", "c_source", "c_target").orderBy("id").limit(k)


def connectivity(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """``(nodes, components, connected)``: nodes ``(node)`` without an edge are components of their own."""
    rows = nodes.select("node").distinct().join(components, "node", "left").agg(F.count("*").alias("nodes"), F.countDistinct(F.coalesce("component", "node")).alias("components"))
    return rows.select("nodes", "components", (F.col("components") == 1).alias("connected"))


def suggested_questions(bridges: DataFrame, hubs: DataFrame, communities: DataFrame, names: DataFrame) -> DataFrame:
    """``(category, place, question)``: on three edges between communities, three hubs and the first two communities.

    ``bridges``: ``(id, source, target)``, ``hubs``: ``(node, score)``, ``communities``: ``(id)``, ``names``: ``(node, name)``.
    """
    def placed(df: DataFrame, k: int, *order) -> DataFrame:  # noqa: ANN002
        return df.orderBy(*order).limit(k).withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # k rows

    called = lambda c: names.select(F.col("node").alias(c), F.col("name").alias(f"{c}_name"))
    one = placed(bridges, 3, "id").join(called("source"), "source", "left").join(called("target"), "target", "left")
    one = one.select(F.lit("cross_community").alias("category"), "place", F.format_string("What is the strategic relationship between %s and %s across domains?", F.coalesce("source_name", "source"), F.coalesce("target_name", "target")).alias("question"))
    two = placed(hubs, 3, F.desc("score"), "node").join(called("node"), "node", "left")
    two = two.select(F.lit("central_hub").alias("category"), "place", F.format_string("Why is %s the most influential entity in this knowledge graph, and what depends on it?", F.coalesce("node_name", "node")).alias("question"))
    three = placed(communities.select("id").distinct(), 2, "id")
    three = three.select(F.lit("boundary").alias("category"), "place", F.format_string("What are the core principles unifying the 'Community %s' cluster?", F.col("id").cast("string")).alias("question"))
    return one.unionByName(two).unionByName(three)
