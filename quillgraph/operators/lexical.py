"""Lexical search: postings, document frequencies and BM25."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.stem import stemmed_tokens, stems
from quillgraph.functions.text import lexical_tokens

K1, B = 1.2, 0.75


def postings(chunks: DataFrame, id_col: str = "id", text_col: str = "text", tokens=lexical_tokens) -> DataFrame:  # noqa: ANN001
    """``(chunk_id, term, tf, length)`` of every chunk."""
    rows = chunks.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("chunk_id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("toks"))
    return rows.select("chunk_id", F.size("toks").cast("bigint").alias("length"), F.explode("toks").alias("term")).groupBy("chunk_id", "term", "length").agg(F.count("*").alias("tf")).select("chunk_id", "term", "tf", "length")


def document_frequencies(posts: DataFrame) -> DataFrame:
    """``(term, df, cf)``: chunks that hold a term, and its occurrences."""
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def idf(n: Column, df: Column) -> Column:
    """Inverse document frequency with the usual floor for terms in most documents."""
    value = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(value <= 0, 1e-6).otherwise(value)


def length_of_counts(tokens: str | Column) -> Column:
    """The Euclidean length of a text's vector of term counts, from its list of tokens."""
    start = F.struct(F.lit("").alias("term"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    step = lambda s, x: F.struct(x.alias("term"), F.when(s["term"] == x, s["run"] + 1).otherwise(1.0).alias("run"), F.when(s["term"] == x, s["sum"]).otherwise(s["sum"] + s["run"] * s["run"]).alias("sum"))
    return F.aggregate(F.array_sort(tokens), start, step, lambda s: F.sqrt(s["sum"] + s["run"] * s["run"]))


def question_counts(question: str) -> dict[str, int]:
    """The terms of a question and how often it has each."""
    return dict(Counter(re.findall(r"[^\W_]+", question.lower())))


def cosine(question: str, text: str | Column) -> Column:
    """The cosine of the vectors of term counts of a question and of a text; 0 where either has no terms.

    Computed within the row: only the question's terms are counted, nothing is shuffled.
    """
    asked = question_counts(question)
    tokens = lexical_tokens(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    times = lambda term: F.size(F.filter(tokens, lambda x: x == term))
    dot = sum((times(t) * F.lit(float(n)) for t, n in asked.items()), F.lit(0.0))
    length = length_of_counts(tokens) * (sum(n * n for n in asked.values()) ** 0.5)
    return F.when(length > 0, dot / length).otherwise(0.0)


def _occurrences(term: str) -> Column:
    return F.size(F.filter("toks", lambda x: x == term))


def bm25(chunks: DataFrame, terms: list[str], every: bool = True, id_col: str = "id", text_col: str = "text", stemmed: bool = False) -> DataFrame:
    """``(chunk_id, score)`` of the chunks that hold the terms (all, or any of them).

    With ``stemmed``, words are compared without diacritics and by their stems.  Only the asked terms are counted, inside the scan of the text: no postings are shuffled.
    """
    asked = sorted({s for t in terms for s in stems(t)} if stemmed else {t.lower() for t in terms})
    text = F.coalesce(F.col(text_col), F.lit(""))
    toks = stemmed_tokens(text) if stemmed else lexical_tokens(text)
    rows = chunks.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("chunk_id"), toks.alias("toks"))
    counted = rows.select("chunk_id", F.size("toks").alias("length"), *[_occurrences(t).alias(f"tf{i}") for i, t in enumerate(asked)])
    total = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.sum((F.col(f"tf{i}") > 0).cast("int")).alias(f"df{i}") for i in range(len(asked))])
    both = counted.crossJoin(F.broadcast(total))  # one row
    part = lambda i: idf(F.col("n"), F.col(f"df{i}")) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    score = sum((part(i) for i in range(len(asked))), F.lit(0.0))
    held = [F.col(f"tf{i}") > 0 for i in range(len(asked))]
    want = held[0]
    for h in held[1:]:
        want = (want & h) if every else (want | h)
    return both.where(want).select("chunk_id", score.alias("score"))
