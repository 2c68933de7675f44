import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillgraph.llm import packing, tokens

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    t = tokenizers.Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


CASES = [None, "", " ", "a  b", "  a", "a \n b", "\n\n  x  \n", "aaaa" * 999, "it's we'll 'll", "<|endoftext|>", "é  ü", "a\x1c b", "日本 語  テ", "​ x", "word " * 3000, "\r\n a\r\n", "x" * 20001]


def test_encode_equals_public_library(spark, reference):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(CASES)], "doc_id bigint, text string, ids string")
    got = {r.doc_id: r.ids for r in tokens.encode_column(df).collect()}
    assert [got[i] for i in range(len(CASES))] == reference(CASES)
    assert got[0] == [] and got[1] == []
    counts = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list(" \n\ta'sbT1٣é漢.,- ")), max_size=40), max_size=5))
def test_encode_any_text(reference, texts):
    own = tokens.encoder(tokens.tokenizer_path(), tokens.split_pattern())
    ids, counts = own.encode(texts)
    at = np.concatenate(([0], np.cumsum(counts)))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == reference(texts)


def test_encode_empty_table(spark):
    assert tokens.encode_column(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def brute_ffd(sizes, capacity):
    room, out = [], []
    for s in sizes:
        for i, r in enumerate(room):
            if r >= s:
                room[i] -= s
                out.append(i)
                break
        else:
            room.append(capacity - s)
            out.append(len(room) - 1)
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_first_fit_decreasing(sizes):
    sizes = sorted(sizes, reverse=True)
    assert packing.first_fit_decreasing(np.array(sizes, np.int64), 100).tolist() == brute_ffd(sizes, 100)


def test_pack_keeps_everything(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(n)) for i, n in enumerate(rng.integers(0, 700, 500))] + [(500, 0), (501, None), (502, 5000), (7, 1)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint").withColumn("capacity", F.lit("clash"))
    windows = spark.createDataFrame([(1, "a", 256), (2, "b", 1000), (3, "c", None), (4, "d", 0)], "window_id int, window_name string, capacity_tokens int")
    placed = packing.pack(sizes, windows, group_size=100)
    want = {}
    for i, n in rows:
        want[i] = max(want.get(i, 0), n or 0)
    for window, capacity in ((1, 256), (2, 1000)):
        got = placed.where(F.col("window_id") == window).collect()
        total, ranges, bins = {}, {}, {}
        for r in got:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
            ranges.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
            if r.bin_id:
                bins[r.bin_id] = bins.get(r.bin_id, 0) + r.n_tokens
            else:
                assert r.n_tokens == 0
        assert total == {i: n for i, n in want.items() if n is not None}
        assert max(bins.values()) <= capacity
        for doc, parts in ranges.items():
            parts.sort()
            assert len(parts) == max(1, -(-want[doc] // capacity))
            assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        assert sum(want.values()) / (len(bins) * capacity) > 0.9
    assert {r.window_id for r in placed.select("window_id").distinct().collect()} == {1, 2}
    assert packing.usage(placed, windows).count() == 2


def test_pack_empty(spark):
    windows = spark.createDataFrame([(1, "a", 256)], "window_id int, window_name string, capacity_tokens int")
    none = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert packing.pack(none, windows).count() == 0
    assert packing.pack(spark.createDataFrame([(1, 5)], "doc_id bigint, n_tokens bigint"), windows.limit(0)).count() == 0
