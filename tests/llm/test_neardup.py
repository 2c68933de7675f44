import random
import re

import numpy as np
import pytest

from quillgraph.llm import neardup

WORDS = [f"w{i}" for i in range(4000)]


def sets(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return set(zip(w, w[1:], w[2:]))


def brute(rows, threshold=0.6):
    out = set()
    s = [(k, sets(t)) for k, t in rows if k is not None]
    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            if a != b and len(x) >= 20 and len(y) >= 20 and len(x & y) / len(x | y) >= threshold:
                out.add((min(a, b), max(a, b)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for i in range(120):
        words = rng.choices(WORDS, k=rng.randint(10, 150))
        out.append((f"n{i:03}", " ".join(words)))
        for v in range(rng.randint(0, 3)):
            edited = list(words)
            for _ in range(rng.randint(0, max(1, len(words) // 12))):
                edited[rng.randrange(len(edited))] = rng.choice(WORDS)
            out.append((f"n{i:03}v{v}", ", ".join(edited).upper() if v == 1 else " ".join(edited)))
    out += [("null", None), ("empty", ""), ("short", "one two"), ("n000", out[0][1]), (None, out[0][1]), ("long", "lang " * 100000 + "end"), ("long2", "lang " * 99999 + "end")]
    return out


def test_pairs_equal_brute_force(spark, rows):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "id string, body string, key string, fp int")
    got = neardup.near_duplicate_pairs({"notes": (df, "id", "body"), "chunks": (df.where("id < 'n03'"), "id", "body")}).collect()
    assert {(r.key_a, r.key_b) for r in got if r.tbl == "notes"} == brute(rows)
    assert {(r.key_a, r.key_b) for r in got if r.tbl == "chunks"} == brute([r for r in rows if r[0] and r[0] < "n03"])
    assert len(got) == len({(r.tbl, r.key_a, r.key_b) for r in got})


def test_groups(spark, rows):
    df = spark.createDataFrame(rows, "id string, body string")
    got = {r.key: r for r in neardup.near_duplicate_groups({"notes": (df, "id", "body")}).collect()}
    assert set(got) == {k for k, _ in rows if k}
    for a, b in brute(rows):
        assert got[a].group_id == got[b].group_id
    assert got["null"].group_id == "null" and got["empty"].class_id == "empty" and got["short"].n_links == 0


def test_empty_table(spark):
    df = spark.createDataFrame([], "id string, body string")
    assert neardup.near_duplicate_pairs({"notes": (df, "id", "body")}).count() == 0
    assert neardup.near_duplicate_groups({"notes": (df, "id", "body")}).count() == 0


def test_prob_min_hash_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate((a[:200], rng.integers(0, 2**63, 100).astype(np.uint64)))
    sig = neardup.prob_min_hash([a, b, a[::-1]], 4096)
    assert abs((sig[0] == sig[1]).mean() - 200 / 400) < 0.04
    assert (sig[0] == sig[2]).all()


def test_prob_min_hash_weights():
    a = np.arange(1, 101).astype(np.uint64)
    w1, w2 = np.ones(100), np.concatenate((np.full(50, 3.0), np.ones(50)))
    sig = neardup.prob_min_hash([a, a], 4096, [w1, w2])
    want = sum(1 / sum(max(w1[y] / w1[x], w2[y] / w2[x]) for y in range(100)) for x in range(100))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.04
