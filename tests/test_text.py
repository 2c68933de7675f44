import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.functions import text as x
from quillgraph.operators import chunking, extraction, lexical


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column("t").alias("r")).first().r


def test_functions(spark):
    assert one(spark, x.sentences, "One. Two here! three? Four\n\nfive. * six") == ["One.", "Two here! three?", "Four", "five.", "* six"]
    assert one(spark, x.token_estimate, "a b c") == 3 and one(spark, x.token_estimate, "") == 1
    assert one(spark, x.preview, "a \n b" + "c" * 300).endswith("...")
    assert one(spark, x.clean_stem, "My  Note-Title.MD") == "my_note_title"
    assert one(spark, x.slug, "!!") == "note" and one(spark, x.slug, "A b!") == "a_b"
    assert one(spark, x.normal_name, "  Fast  API! ") == "fast api"
    assert one(spark, x.wikilinks, "[[a b#c|d]] and [[e]]") == ["a b", "e"]
    assert one(spark, x.front_matter, "---\ntitle: A: b\ntags: [x, y]\ntitle: C\n---\nbody") == {"title": "C", "tags": "[x, y]"}
    assert one(spark, x.body, "---\na: b\n---\nbody") == "body"
    assert one(spark, x.first_heading, "x\n# Head \n") == "Head" and one(spark, x.first_heading, "none") is None
    assert one(spark, x.tag_list, "[a, 'b', \"c\",]") == ["a", "b", "c"] and one(spark, x.tag_list, None) == []


def test_rewriting(spark):
    df = spark.createDataFrame([("Hi {name}, {gone} {name}", {"name": "A$1", "x": "y"}, "a b a b", "b", "C", "---\ntags: [x]\n---\nbody\n---\nin\n---\nend", ["p", "q"])], "t string, v map<string,string>, c string, o string, n string, note string, tags array<string>")
    r = df.select(x.filled("t", "v").alias("f"), x.replaced_once("c", "o", "n").alias("r"), x.replaced_once("c", F.lit("zz"), "n").alias("none"), x.retagged("note", "tags").alias("g"), x.unfenced("note").alias("u")).first()
    assert (r.f, r.r, r.none) == ("Hi A$1, ... A$1", "a C a b", None)
    assert r.g.startswith("---\ntags: [p, q]\n---") and r.u == "body\nend"


def test_html(spark):
    html = "<html><head><title>A &amp; B</title><style>x</style></head><body><h1>Top</h1><p>Some <b>bold</b> <em>text</em></p><ul><li>one</li></ul><script>bad()</script></body></html>"
    assert one(spark, x.html_title, html) == "A   B"
    assert one(spark, x.html_to_markdown, html.replace("<title>A &amp; B</title>", "")) == "# Top\n\nSome **bold** *text*\n\n- one"


def model(body, target, overlap, least):
    """The chunker's rule once more, in the plainest form."""
    parts = [s.strip() for s in re.split(x.SENTENCE_END, body) if s and s.strip()]
    size = lambda s: max(1, int(len(s.split()) * 1.3))
    out, cur = [], []
    for s in parts:
        if cur and sum(map(size, cur)) + size(s) > target:
            if sum(map(size, cur)) >= least:
                out.append((" ".join(cur), sum(map(size, cur))))
            keep = []
            for c in reversed(cur):
                if sum(map(size, keep)) + size(c) > overlap:
                    break
                keep.insert(0, c)
            cur = keep
        cur.append(s)
    if cur:
        out.append((" ".join(cur), size(" ".join(cur))))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=30))
def test_chunker_model(lengths):
    body = " ".join("W" + " w" * (n - 1) + "." for n in lengths)
    parts = [s.strip() for s in re.split(x.SENTENCE_END, body) if s and s.strip()]
    assert [(t, n) for t, _, _, n in chunking.pack(body, parts, 60, 15, 20)] == model(body, 60, 15, 20)


def test_chunk_notes(spark):
    body = " ".join(f"Sentence number {i} has some words in it." for i in range(100))
    df = spark.createDataFrame([("a", body), ("b", None), ("c", " "), (None, body)], "id string, raw_content string")
    got = chunking.chunk_notes(df).orderBy("chunk_index").collect()
    assert {r.note_id for r in got} == {"a"} and [r.chunk_index for r in got] == list(range(len(got)))
    assert got[0].start_char == 0 and all(r.text.startswith("Sentence") for r in got)


def test_extraction(spark):
    df = spark.createDataFrame([("c1", "The **Vector Store** uses `faiss`. Alice Chen met Alice Chen and **faiss** in Berlin.")], "id string, text string")
    ent = extraction.chunk_entities(df)
    got = [(r.name, r.type, r.confidence) for r in ent.orderBy("ord").collect()]
    assert got == [("Vector Store", "CONCEPT", 0.8), ("faiss", "CONCEPT", 0.8), ("Alice Chen", "PERSON", 0.75), ("Berlin", "CONCEPT", 0.75)]
    assert [(r.subject, r.object) for r in extraction.chunk_relations(ent).orderBy("ord").collect()] == [("Vector Store", "faiss"), ("faiss", "Alice Chen"), ("Alice Chen", "Berlin")]


def test_answers(spark):
    df = spark.createDataFrame([("c1", 'Here: ```json\n{"entities": [{"name": " A "}, {"type": "x"}], "relations": [{"subject": "A", "object": "B", "predicate": "works for"}, {"subject": "A"}]}\n```'), ("c2", "no json")], "chunk_id string, answer string")
    entities, relations = extraction.parse_answers(df)
    assert [(r.name, r.type, r.confidence) for r in entities.collect()] == [("A", "CONCEPT", 0.95)]
    assert [(r.subject, r.predicate, r.object, r.confidence) for r in relations.collect()] == [("A", "WORKS_FOR", "B", 0.9)]


def test_bm25(spark):
    df = spark.createDataFrame([("a", "graph graph vector"), ("b", "graph only here"), ("c", "nothing"), ("d", None), ("e", "other words"), ("f", "more words")], "id string, text string")
    assert [r.chunk_id for r in lexical.bm25(df, ["Graph", "vector"]).collect()] == ["a"]
    ranked = [r.chunk_id for r in lexical.bm25(df, ["graph", "vector"], every=False).orderBy(F.desc("score")).collect()]
    assert ranked == ["a", "b"]
    assert lexical.postings(df).count() == 10
