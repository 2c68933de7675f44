import random

import pytest

from quillgraph.llm import scans

WORDS = "pipeline retrieval summarised persistent importer structured vocabulary experiment annotated relation background threshold corpus evaluated interface semantic cluster measured temporal between another workshop language question response".split()
SCHEMA = "id string, raw_content string, ingested_at timestamp_ntz, word string, kind string"
CHUNK = "id string, note_id string, start_char int, end_char int, text string, line_no string"


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(1)
    clean = [(f"c{i}", " ".join(rng.choices(WORDS, k=200)) + " long-term k8s", None, "x", "y") for i in range(30)]
    page = (
        "# Some Title\n\n## Page 1\n\nSome Title\npipeline retrieval persistent impor-\nter structured vocabulаry experiment\nannotated relation long-\nterm background threshoId\n12\n"
        "\n## Page 2\n\nSorne Title\ncorpus evaluated k8s interface sem-\n13\n\n## Page 3\n\nSome Title\nantic cluster measured tliat temporal\nbetween another workshop.\n\nNew paragraph question response.\n14"
    )
    rows = clean + [("s1", page, None, "x", "y"), ("s1", page, None, "x", "y"), ("n1", None, None, "x", "y"), ("n2", "", None, "x", "y"), (None, page, None, "x", "y"), ("p0", "## Page 1\n", None, "x", "y"), ("big", "## Page 1\n" + "x" * 100000 + "\n# " + "y " * 50000, None, "x", "y")]
    notes = spark.createDataFrame(rows, SCHEMA)
    start = page.index("corpus")
    alone = "## Page 4\npipeline retrieval impor-\nter background threshoId"
    chunks = spark.createDataFrame([("s1_chunk_7", None, start, len(page), "t", "x"), ("lost", "nowhere", 0, 60, alone, "x"), ("s1_chunk_0", " S1 ", start, len(page), "t", "x"), ("k", None, 0, 5, None, None), (None, "s1", 0, 9, "t", "x"), ("s1_chunk_1", "s1", None, None, "t", "x")], CHUNK)
    return notes, chunks


def test_found(data):
    got = {(r.line_no, r.kind) for r in scans.noisy_lines(data[0]).where("note_id = 's1'").collect()}
    assert got == {(5, "header"), (6, "hyphen"), (7, "misread"), (9, "misread"), (10, "pageno"), (14, "header"), (15, "hyphen"), (16, "pageno"), (20, "header"), (25, "pageno")} | {k for k in got if k == (21, "misread")}


def test_repaired(data):
    got = {(r.tbl, r.id): r.text for r in scans.repaired(*data).collect()}
    text = got["notes", "s1"]
    assert text.startswith("pipeline retrieval persistent importer structured vocabulary experiment annotated relation long-term background threshold corpus evaluated k8s interface semantic cluster")
    assert text.split("\n\n")[1] == "New paragraph question response."
    assert got["chunks", "s1_chunk_0"].startswith("corpus evaluated k8s interface semantic cluster")
    assert ("chunks", "s1_chunk_1") not in got
    assert got["chunks", "s1_chunk_7"] == got["chunks", "s1_chunk_0"]
    assert got["chunks", "lost"] == "pipeline retrieval importer background threshold"
    assert set(got) == {("notes", "s1"), ("notes", "big"), ("chunks", "s1_chunk_0"), ("chunks", "s1_chunk_7"), ("chunks", "lost")}


def test_neighbours_are_counted_alike_at_any_size(data, spark, monkeypatch):
    notes = spark.createDataFrame([("a", "Modern- art, and (modern) ART. well-known cat!\nDog can't art"), ("b", None), ("c", "")], "id string, raw_content string")
    wanted = spark.createDataFrame([("art",), ("cat",)], "w string")
    few = {tuple(r) for r in scans.neighbour_counts(notes, wanted).collect()}
    monkeypatch.setattr(scans, "MOST_WANTED", 1)
    assert {tuple(r) for r in scans.neighbour_counts(notes, wanted).collect()} == few
    assert ("modern", "art", 2) in few and ("well-known", "cat", 1) in few


def test_confusions_are_learned(spark):
    """A confusion that no list has: k is read for w in scanned pages; clean notes have rare words that end in s."""
    assert scans.confusion("tliat", "that") == "li>h" and scans.confusion("modem", "modern") == "m>rn" and scans.confusion("cats", "cat") is None
    words = ["window", "willow", "shadow", "yellow", "narrow", "wisdom", "weather", "between", "always", "network"]
    met = [(w.replace("w", "k", 1), w, 0) for w in words] + [(w[:-1] + c, w, k) for w in words for c, k in (("q", 1), ("j", 2))]
    got = scans.learned_confusions(spark.createDataFrame(met, "word string, repair string, n_clean bigint"))
    assert got == [("k", "w")]
    costs = scans.confusion_pairs(got)
    assert scans.weighted_distance("kindow", "window", scans.LIMIT, costs) == pytest.approx(scans.LEARNED) and scans.weighted_distance("kindow", "window") >= 1


def test_empty(spark):
    notes, chunks = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], CHUNK)
    assert scans.noisy_lines(notes).count() == 0
    assert scans.repaired(notes, chunks).count() == 0


def test_weighted_distance():
    assert scans.weighted_distance("tliat", "that") == pytest.approx(0.3)
    assert scans.weighted_distance("threshold", "threshold") == 0
    assert scans.weighted_distance("bat", "cat") >= 1


def test_page_headings(spark):
    texts = ["# Page Ranking Ideas\ntext", "x\n## Page 3\ny", "## page xiv\r\ny", "page 3", None]
    got = [r.s for r in spark.createDataFrame(list(enumerate(texts)), "i int, raw_content string").select("i", scans.is_scanned().alias("s")).orderBy("i").collect()]
    assert got == [False, True, True, False, None]


def test_deletes():
    assert set(scans.deletes("abc")) == {"abc", "ab", "ac", "bc", "a", "b", "c"}
