"""Ranked retrieval: graph scores of chunks, communities, rank fusion, citations, routing of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import ascii_words
from quillgraph.operators.lexical import cosine
from quillgraph.operators.references import key, listed_keys
from quillgraph.operators.vault import community_members, provenance

RRF_K = 60
# Phrases that ask for the whole collection, and the pairs of words that do.
GLOBAL_PHRASES = ["theme", "themes", "overview", "summarize", "summary", "main topics", "overall", "entire", "all notes", "high level", "big picture", "broad", "structure", "communities", "clusters", "landscape", "what do i know about everything"]
GLOBAL_PAIR = r"\b(?:main|major|primary|key)\s+(?:themes|points|ideas|concepts|topics)\b"
# Words that carry no content in a question.
STOP_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before",
    "being", "below", "between", "both", "but", "by", "can", "did", "do", "does", "doing", "don", "down", "during", "each", "few", "for", "from",
    "further", "had", "has", "have", "having", "he", "her", "here", "hers", "herself", "him", "himself", "his", "how", "i", "if", "in", "into", "is",
    "it", "its", "itself", "just", "me", "more", "most", "my", "myself", "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other",
    "our", "ours", "ourselves", "out", "over", "own", "s", "same", "she", "should", "so", "some", "such", "t", "than", "that", "the", "their",
    "theirs", "them", "themselves", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "very", "was",
    "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "would",
]


def mode(question: str | Column) -> Column:
    """``global`` for questions on the whole collection, else ``local``."""
    text = F.lower(ascii_words(question))
    return F.when(text.rlike(r"\b(?:" + "|".join(GLOBAL_PHRASES) + r")\b") | text.rlike(GLOBAL_PAIR), "global").otherwise("local")


def content_words(question: str | Column) -> Column:
    """The words of a question that carry content, in order."""
    found = F.regexp_extract_all(ascii_words(question), F.lit(r"[a-zA-Z0-9_-]+"), 0)
    return F.filter(found, lambda w: ~F.lower(w).isin(STOP_WORDS))


def keyword_grams(question: str | Column) -> Column:
    """Runs of three, two and one content words."""
    w = content_words(question)

    def runs(size: int) -> Column:
        return F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda i: i <= F.size(w) - size + 1), lambda i: F.array_join(F.slice(w, i, size), " "))

    return F.array_distinct(F.concat(runs(3), runs(2), runs(1)))


def bridge_edges(view: DataFrame, nodes_latest: DataFrame) -> DataFrame:
    """Edges between nodes of different communities, with both communities."""
    of = nodes_latest.where("community_id IS NOT NULL").select(key("id").alias("node"), "community_id")
    a, b = of.select(F.col("node").alias("source"), F.col("community_id").alias("c_source")), of.select(F.col("node").alias("target"), F.col("community_id").alias("c_target"))
    return view.join(a, "source").join(b, "target").where("c_source <> c_target")


def chunk_scores(matched: DataFrame, near: DataFrame, top: DataFrame, bridges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(chunk, score)`` added up over four channels.

    ``matched``: nodes ``(id, degree)`` that the question names, 1.5 a chunk and more with their degree; ``near``: their
    edges ``(weight, confidence, provenance)``; ``top``: members ``(node)`` of the best communities, 0.8 each; ``bridges``:
    edges ``(provenance)`` between communities, 1.2 each.
    """
    prov = provenance(nodes)
    parts = [
        prov.join(matched.select("id", (1.5 * (1 + 0.1 * F.least("degree", F.lit(10)))).alias("s")), "id").select("chunk", "s"),
        near.select(F.explode(listed_keys("provenance")).alias("chunk"), (F.col("weight") * F.col("confidence")).alias("s")),
        prov.withColumn("node", key("id")).join(top.select("node"), "node").select("chunk", F.lit(0.8).alias("s")),
        bridges.select(F.explode(listed_keys("provenance")).alias("chunk"), F.lit(1.2).alias("s")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("chunk").agg(F.sum("s").alias("score"))


def named_nodes(nodes_latest: DataFrame, keywords: list[str], question: str, k: int) -> DataFrame:
    """``(id, name, type, description, degree, place)`` of at most ``k`` nodes that a question means.

    First, for each keyword in turn, the ``k`` nodes of highest degree whose name or description holds it; then nodes by id
    whose name stands in the question, or whose name holds a keyword.
    """
    rows = nodes_latest.select("id", "name", "type", "description", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))
    name = F.lower("name")
    both = F.lower(F.concat_ws("\n", "name", "description"))
    hits = F.array_compact(F.array(*[F.when(both.contains(w.lower()), i) for i, w in enumerate(keywords)])) if keywords else F.array().cast("array<int>")
    found = rows.select("*", F.explode(hits).alias("turn"))
    first = found.withColumn("r", F.row_number().over(Window.partitionBy("turn").orderBy(F.desc("degree"), "id"))).where(F.col("r") <= k).drop("r")
    holds = reduce(lambda a, b: a | b, [name.contains(w.lower()) for w in keywords], F.lit(False))
    later = rows.where(((name != "") & F.lit(question.lower()).contains(name)) | holds).orderBy("id").limit(2 * k).withColumn("turn", F.lit(len(keywords)))
    order = F.struct("turn", F.when(F.col("turn") < len(keywords), -F.col("degree")).otherwise(0).alias("d"), "id")
    once = first.unionByName(later).groupBy("id").agg(F.min(F.struct(order.alias("o"), "name", "type", "description", "degree")).alias("x"))
    top = once.select("id", "x.*").orderBy("o").limit(k)
    return top.select("id", "name", "type", "description", "degree", F.row_number().over(Window.orderBy("o")).cast("bigint").alias("place"))  # k rows


def dense_list(chunks: DataFrame, question: str, k: int) -> DataFrame:
    """``(chunk, score)`` of the ``k`` chunks whose vectors of term counts are nearest to the question's."""
    rows = chunks.select(key("id").alias("chunk"), F.round(cosine(question, "text"), 9).alias("score"))
    return rows.where("score > 0").orderBy(F.desc("score"), "chunk").limit(k)


def community_scores(communities: DataFrame, high: list[str], low: list[str], question: str = "") -> DataFrame:
    """``(id, score)``: 2 for every high-level and 0.5 for every low-level keyword in name, summary and themes, and 3 times
    the cosine of question and summary."""
    themes = F.array_join(F.coalesce(F.from_json("themes", "array<string>"), F.array().cast("array<string>")), " ")
    text = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("summary", F.lit("")), themes))
    score = reduce(lambda a, b: a + b, [F.when(text.contains(k.lower()), w).otherwise(0.0) for w, ks in ((2.0, high), (0.5, low)) for k in ks], F.lit(0.0))
    return communities.select("id", (score + 3 * cosine(question, "summary")).alias("score") if question else score.alias("score"))


def best_communities(scored: DataFrame, k: int = 3) -> DataFrame:
    """The best communities with a score; the first ones where none has any."""
    w = Window.orderBy(F.desc("hit"), F.desc("score"), "id")
    return scored.withColumn("hit", F.col("score") > 0).orderBy(F.desc("score"), "id").limit(k).withColumn("any", F.max("hit").over(Window.partitionBy(F.lit(1)))).withColumn("rank", F.row_number().over(w)).where("hit OR NOT any").select("id", "score", F.col("rank").cast("bigint").alias("rank"))


def top_members(communities: DataFrame, chosen: DataFrame, size: int = 10) -> DataFrame:
    """``(node)`` of the first members of the chosen communities, once per community."""
    return community_members(communities).where(F.col("pos") < size).join(chosen.select("id"), "id", "left_semi").select("id", "node")


def reciprocal_rank_fusion(lists: list[tuple[DataFrame, float]], k: int) -> DataFrame:
    """``(chunk, score)`` of the best ``k``: each list ``(chunk, score)`` gives weight / (60 + rank)."""
    parts = []
    for scored, weight in lists:
        top = scored.orderBy(F.desc("score"), "chunk").limit(10 * k)
        rank = F.row_number().over(Window.orderBy(F.desc("score"), "chunk"))
        parts.append(top.select("chunk", (F.lit(weight) / (RRF_K + rank)).alias("s")))
    fused = reduce(DataFrame.unionByName, parts).groupBy("chunk").agg(F.sum("s").alias("score"))
    return fused.orderBy(F.desc(F.round("score", 9)), "chunk").limit(k)


def citations(ranked: DataFrame, chunks: DataFrame, notes: DataFrame, snippet: int = 300) -> DataFrame:
    """``(chunk, title, snippet, score)`` of ranked chunks; the title is the chunk's key where its note is unknown."""
    c = chunks.select(key("id").alias("chunk"), key("note_id").alias("note"), F.substring("text", 1, snippet).alias("snippet")).dropDuplicates(["chunk"])
    n = notes.select(key("id").alias("note"), "title").dropDuplicates(["note"])
    return F.broadcast(ranked).join(c, "chunk").join(n, "note", "left").select("chunk", F.coalesce("title", "chunk").alias("title"), "snippet", "score")


def entity_citations(matched: DataFrame, k: int = 3) -> DataFrame:
    """``(id, title, snippet, score)`` of the first ``k`` nodes that a question means."""
    said = F.coalesce("description", F.format_string("Entity: %s (%s)", "name", "type"))
    return matched.where(F.col("place") <= k).select("id", F.col("name").alias("title"), said.alias("snippet"), F.lit(1.0).alias("score"))


def context_block(matched: DataFrame, relations: DataFrame, communities: DataFrame, cited: DataFrame) -> DataFrame:
    """``(context)``: one text of what an answer may build on: 6 entities, 6 relations, 3 communities, all excerpts.

    ``matched`` as of :func:`named_nodes`, ``relations``: ``(id, source, predicate, target)``, ``communities``: ``(rank, name,
    summary)``, ``cited``: ``(chunk, title, snippet, score)``; each has a few rows only.
    """
    def line(df: DataFrame, head: str, order: Column, text: Column, divider: str) -> DataFrame:
        rows = df.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))).alias("rows"))
        return rows.select(F.when(F.size("rows") > 0, F.concat(F.lit(head), F.array_join(F.transform("rows", lambda x: x["t"]), divider))).alias("t"))

    parts = [
        line(matched.where("place <= 6"), "Entities: ", F.col("place"), F.format_string("%s (%s)", "name", "type"), ", "),
        line(relations.orderBy("id").limit(6), "Relations: ", F.col("id"), F.format_string("%s %s %s", "source", "predicate", "target"), "; "),
        line(communities.where("rank <= 3"), "Communities: ", F.col("rank"), F.format_string("%s: %s", "name", F.coalesce("summary", F.lit(""))), "\n"),
        line(cited, "Excerpts:\n", F.struct(-F.col("score"), F.col("chunk")), F.format_string("[%s]: %s", "title", "snippet"), "\n"),
    ]
    every = reduce(DataFrame.unionByName, [p.withColumn("i", F.lit(i)) for i, p in enumerate(parts)])
    return every.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]), "\n").alias("context"))


def agreement(one: DataFrame, two: DataFrame) -> DataFrame:
    """``(n_one, n_two, overlap, jaccard)`` of two result lists ``(chunk)``, as for a search with a part left out."""
    a, b = one.select("chunk", F.lit(1).alias("a")).distinct(), two.select("chunk", F.lit(1).alias("b")).distinct()
    sums = a.join(b, "chunk", "full").agg(F.count("a").alias("n_one"), F.count("b").alias("n_two"), F.count(F.col("a") + F.col("b")).alias("overlap"), F.count("*").alias("n"))
    return sums.select("n_one", "n_two", "overlap", F.round(F.when(F.col("n") > 0, F.col("overlap") / F.col("n")).otherwise(0.0), 3).alias("jaccard"))


def internal_edges(view: DataFrame, communities: DataFrame) -> DataFrame:
    """``(community, id, source, predicate, target)``: edges with both ends in a community."""
    m = community_members(communities).select(F.col("id").alias("community"), "node").distinct()
    a, b = m.withColumnRenamed("node", "source"), m.withColumnRenamed("node", "target")
    return view.select("id", "source", "predicate", "target").join(a, "source").join(b, ["community", "target"]).select("community", "id", "source", "predicate", "target")


def community_summaries(communities: DataFrame, nodes_latest: DataFrame, inside: DataFrame) -> DataFrame:
    """``(community, n_members, n_edges, themes, summary)``: the names of the first members and the first edges in words."""
    names = nodes_latest.select(key("id").alias("node"), "name")

    def firsts(df: DataFrame, order: str, text: Column, n: str, out: str) -> DataFrame:
        """The number of rows of each community and its first five; no community's rows are gathered."""
        rows = df.select("community", order, text.alias("t"))
        place = F.row_number().over(Window.partitionBy("community").orderBy(order, "t"))
        five = rows.withColumn("place", place).where("place <= 5").groupBy("community").agg(F.array_sort(F.collect_list(F.struct("place", "t"))).alias(out))
        return rows.groupBy("community").agg(F.count("*").alias(n)).join(five, "community")

    members = firsts(community_members(communities).join(names, "node").withColumnRenamed("id", "community"), "pos", F.col("name"), "n_members", "m")
    edges = firsts(inside, "id", F.concat_ws(" ", "source", F.lower("predicate"), "target"), "n_edges", "e")
    rows = members.join(edges, "community", "left")
    themes = F.array_join(F.transform("m", lambda x: x["t"]), ", ")
    said = F.coalesce(F.array_join(F.transform("e", lambda x: x["t"]), "; "), F.lit("interconnected conceptual relationships"))
    return rows.select("community", "n_members", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), themes.alias("themes"), F.concat(F.lit("Thematic cluster focusing on "), themes, F.lit(". Key relationships include: "), said, F.lit(".")).alias("summary"))


def leading_themes(communities: DataFrame, k: int = 8) -> DataFrame:
    """``(theme, n, first_id)``: the first ``k`` different themes in the order of the communities and their lists."""
    each = communities.select("id", F.posexplode(F.from_json("themes", "array<string>")).alias("pos", "theme"))
    first = each.groupBy("theme").agg(F.min(F.struct("id", "pos")).alias("at"), F.count("*").alias("n"))
    return first.orderBy("at", "theme").limit(k).select("theme", "n", F.col("at.id").alias("first_id"))


def global_insights(communities: DataFrame, snippet: int = 250) -> DataFrame:
    """``(id, insight, score)`` of the communities of level 0 with a summary (of all levels where there is none)."""
    some = communities.where("summary IS NOT NULL")
    some = some.crossJoin(F.broadcast(some.agg(F.min("level").alias("lowest"))))  # one row
    return some.where("level = 0 OR lowest > 0").select("id", F.concat(F.col("name"), F.lit(": "), F.substring("summary", 1, snippet)).alias("insight"), F.coalesce("confidence", F.lit(1.0)).alias("score"))


def answer_scores(rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """Context precision, faithfulness and relevance of answers by shared words.

    ``rows``: ``(id, question, answer)``, ``contexts``: ``(id, context)``; nulls count as empty.  Each context is compared
    on its own and only counts and shared words are added up, so the contexts of an id are never gathered.
    """
    toks = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda x: x != ""))
    r = rows.select("id", toks(F.col("question")).alias("q"), toks(F.col("answer")).alias("a"))
    met = contexts.select("id", toks(F.col("context")).alias("c")).join(r, "id").select("id", F.arrays_overlap("c", "q").alias("hit"), F.array_intersect("a", "c").alias("common"))
    counts = met.groupBy("id").agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"))
    words = met.select("id", F.explode("common").alias("w")).distinct().groupBy("id").agg(F.count("*").alias("grounded"))
    r = r.join(counts, "id", "left").join(words, "id", "left")
    precision = F.coalesce("hits", F.lit(0)) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))
    faith = F.least(F.lit(1.0), F.coalesce("grounded", F.lit(0)) / F.greatest(F.lit(1.0), F.size("a") * 0.7))
    relevance = F.least(F.lit(1.0), F.size(F.array_intersect("q", "a")) / F.greatest(F.lit(1.0), F.size("q") * 0.5))
    return r.select("id", F.round(precision, 3).alias("context_precision"), F.round(faith, 3).alias("faithfulness"), F.round(relevance, 3).alias("answer_relevance"), F.round(precision * 0.3 + faith * 0.4 + relevance * 0.3, 3).alias("overall"))
