from datetime import datetime as dt

from quillgraph.operators import classify, page_layout
from quillgraph.operators import vault_reports as reports
from quillgraph.sources import markdown


def test_markdown_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "My Note.md").write_text("---\ntitle: The Title\ntags: [a, b]\n---\n# Head\nbody", encoding="utf-8")
    (tmp_path / "sub" / "two.markdown").write_text("# Two\ntext", encoding="utf-8")
    (tmp_path / "empty.md").write_text(" \n", encoding="utf-8")
    (tmp_path / "other.txt").write_text("x", encoding="utf-8")
    notes = markdown.read_markdown(spark, str(tmp_path))
    got = {r.id: r for r in notes.collect()}
    assert set(got) == {"my_note", "two"}
    assert (got["my_note"].title, got["my_note"].tags, got["two"].title) == ("The Title", '["a","b"]', "Two")
    stored = spark.createDataFrame([("my_note", "/x/my note.md", None, dt(2024, 1, 1)), ("gone", "/x/gone.md", None, dt(2024, 1, 1)), ("two", "/x/two.markdown", dt(2024, 1, 2), dt(2024, 1, 1))], "id string, source_file string, deleted_at timestamp_ntz, ingested_at timestamp_ntz")
    assert {(r.id, r.origin) for r in markdown.match_disk(stored, notes).collect()} == {("my_note", "stored")}
    assert {(r.id, r.origin) for r in markdown.match_disk(stored.limit(0), notes).collect()} == {("my_note", "new"), ("two", "new")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b'), (2, None)], "i int, s string")
    for kind in ("parquet", "json", "csv"):
        markdown.write(df, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).where("i = 1").first().s == 'a "q", b'
    results = spark.createDataFrame([("success", 2, 90.0), ("error", None, None), (None, None, None)], "status string, pages int, confidence double")
    assert tuple(markdown.ingest_summary(results).first()) == (3, 1, 2, 2, 90.0)


SEG = "page_id int, seg_id int, text string, confidence double, x double, y double, w double, h double"


def test_cells_and_tables(spark):
    rows = [(1, 10 * r + c, f"r{r}c{c}", 90.0, 200.0 * c, 30.0 * r + c, 50.0, 10.0) for r in range(4) for c in range(3)]
    rows += [(1, 99, "near", 50.0, 55.0, 0.0, 30.0, 10.0), (2, 1, "alone", 70.0, 0.0, 0.0, 10.0, 10.0), (2, 2, "none", 70.0, 0.0, 0.0, 0.0, 0.0)]
    seg = spark.createDataFrame(rows, SEG)
    got = {(r.row, r.cell): r.text for r in page_layout.cells(seg).where("page_id = 1").collect()}
    assert got[0, 0] == "r0c0 near" and got[3, 2] == "r3c2" and len(got) == 12
    assert [tuple(r) for r in page_layout.tables(seg).collect()] == [(1, 3, 4)]
    assert tuple(page_layout.confidence_buckets(seg).where("page_id = 1").first())[1:5] == (13, 12, 0, 1)
    assert page_layout.doubtful(seg).where("doubt = 'low'").count() == 1


def test_reading_order_and_markdown(spark):
    rows = [(1, i, f"L{i}", 90.0, 0.0, 20.0 * i, 100.0, 10.0) for i in range(6)] + [(1, 10 + i, f"R{i}", 90.0, 200.0, 20.0 * i, 100.0, 10.0) for i in range(6)]
    rows += [(2, 1, "Title", 90.0, 0.0, 0.0, 90.0, 25.0), (2, 2, "one", 90.0, 0.0, 40.0, 90.0, 10.0), (2, 3, "two", 90.0, 0.0, 52.0, 90.0, 10.0), (2, 4, "three", 90.0, 0.0, 90.0, 90.0, 10.0)]
    seg = spark.createDataFrame(rows, SEG)
    assert [r.text for r in page_layout.reading_order(seg).where("page_id = 1").orderBy("place").collect()] == [f"L{i}" for i in range(6)] + [f"R{i}" for i in range(6)]
    assert page_layout.markdown(seg).where("page_id = 2").first().text == "# Title\n\none\ntwo\n\nthree"


def test_reports(spark):
    turns = spark.createDataFrame([("s", i, f"t{i}") for i in range(20)] + [("u", 1, "x")], "session string, at int, line string")
    last = reports.last_messages(turns, "session", ["at"], 12).where("session = 's'").orderBy("place").collect()
    assert [r.at for r in last] == list(range(8, 20)) and [r.place for r in last] == list(range(1, 13))
    degrees = spark.createDataFrame([(f"n{i}", i % 3) for i in range(90)], "node string, degree int")
    spiral = reports.spiral_layout(degrees).collect()
    assert len(spiral) == 60 and sorted(r.i for r in spiral) == list(range(60))
    assert all(319 <= (r.x**2 + r.y**2) ** 0.5 <= 1001 for r in spiral)


def test_classify(spark):
    docs = spark.createDataFrame([(1, "The contract and the balance sheet: revenue, revenue! An excellent growth. URGENT"), (2, "nothing at all"), (3, None), (4, "")], "i int, t string")
    got = {(r.id, r.topic): r.score for r in classify.topic_scores(docs, "i", "t").collect()}
    assert got == {(1, "Legal"): 1.0, (1, "Financial"): 4.0, (2, "General"): 1.0, (4, "General"): 1.0}
    tone = {r.id: (r.sentiment, r.priority) for r in classify.tone(docs, "i", "t").collect()}
    assert tone == {1: ("positive", "urgent"), 2: ("neutral", "medium"), 4: ("neutral", "medium")}
    assert spark.range(1).select(classify.bar(classify.F.lit(50.0), 4).alias("b")).first().b == "██░░"
