import random

from pyspark.sql import functions as F

from quillgraph.llm import reading

LEVEL_WORDS = {k: [f"{c}{w}" for w in ("alo", "bem", "cid", "dor", "eku", "fam", "gil", "hon", "ip", "jus", "kel", "lom")] for k, c in zip(range(1, 6), "pqrst")}


def text(rng, level, n=90):
    out = []
    while len(out) < n:
        near = min(5, max(1, level + rng.choice([0, 0, 0, 0, 1, -1])))
        out.append(rng.choice(LEVEL_WORDS[near]))
    return " ".join(out) + "."


def tables(spark, docs, graded):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id bigint, text string, terms string, level int")
    g = spark.createDataFrame(graded, "passage_id bigint, lang string, level int, text string")
    return d, g


def test_levels(spark):
    rng = random.Random(2)
    truth = {i: rng.randint(1, 5) for i in range(300)}
    docs = [(i, "# heading\n" + text(rng, k)) for i, k in truth.items()]
    docs += [(1000, None), (1001, ""), (1002, "  \n"), (1003, "too few words"), (1004, "def f(x):\n" * 100), (1005, "2024-01-01T00:00:00Z level=INFO x=1\n" * 50), (1006, "漢字 " * 80), (1007, "pa" * 150000), (1008, "word " * 40000)]
    graded = [(i, "en", 1 + i % 5, text(rng, 1 + i % 5)) for i in range(60)] + [(99, None, 3, None), (98, "en", 9, "bad level"), (97, None, 2, text(rng, 2))]
    rows = {r.doc_id: r for r in reading.reading_levels(*tables(spark, docs, graded)).collect()}
    assert len(rows) == len(docs)
    right = sum(rows[i].level == k for i, k in truth.items())
    assert right / len(truth) > 0.95
    assert all(rows[i].level is None for i in (1000, 1001, 1002, 1003, 1004, 1005, 1007))
    assert rows[1006].level == 3  # not connected: the passages' mean
    assert 1 <= rows[1008].level <= 5


def test_no_passages_or_documents(spark):
    d, g = tables(spark, [(1, "word " * 100)], [])
    assert [r.level for r in reading.reading_levels(d, g).collect()] == [None]
    d, g = tables(spark, [], [(1, "en", 2, "some words here")])
    assert reading.reading_levels(d, g).count() == 0
    d, g = tables(spark, [], [])
    assert reading.reading_levels(d, g).count() == 0


def test_prose():
    got = reading.prose("---\ntitle: x\n---\n# Head\nSome text here [4] see http://a.b/c `code` end.\n- [[link]] https://x\n    a['b'] = 3\ndef f(x):\n")
    assert got.split() == ["Some", "text", "here", "see", "end."]


def test_repeated_rows(spark):
    d, g = tables(spark, [(1, "word " * 100), (1, "word " * 100)], [(1, "en", 2, "word other"), (2, "en", 4, "far away")])
    got = reading.reading_levels(d, g)
    assert got.count() == 2 and got.select("level").distinct().count() == 1
    assert got.where(F.col("n_words") != 100).count() == 0
