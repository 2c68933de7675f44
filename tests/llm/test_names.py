import random
import string

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import names


def brute_distance(a, b):
    """Unrestricted Damerau-Levenshtein distance."""
    da, most = {}, len(a) + len(b)
    d = {(-1, -1): most}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = most, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = most, j
    for i in range(1, len(a) + 1):
        db = 0
        for j in range(1, len(b) + 1):
            k, last, cost = da.get(b[j - 1], 0), db, 1
            if a[i - 1] == b[j - 1]:
                cost, db = 0, j
            d[i, j] = min(d[i - 1, j - 1] + cost, d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, last - 1] + (i - k - 1) + 1 + (j - last - 1))
        da[a[i - 1]] = i
    return d[len(a), len(b)]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=8), st.text("abc", max_size=8))
def test_distance(a, b):
    assert names.distance(a, b) == brute_distance(a, b)
    assert names.within_one(a, b) == (brute_distance(a, b) <= 1)


def test_radius_join_is_exact(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("aeioulmnrst", k=rng.randint(3, 10))) for _ in range(300)]
    for w in list(words):
        for _ in range(2):
            i = rng.randrange(len(w))
            words.append(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(string.ascii_lowercase) + w[i:], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]]))
    long = "".join(rng.choices("abcdefgh", k=60))
    words += [long, long[1:], long[:-1], long[:30] + "x" + long[30:], long[:29] + long[29:31][::-1] + long[31:], "q" + long[1:], long[:48], long[:49], long[2:]]
    words = sorted({w for w in words if w})
    df = spark.createDataFrame([(w, 1) for w in words + words[:5]] + [(None, 1), ("", 1), ("z" * 5000, 1)], "word string, d int")
    got = {(r.a, r.b) for r in names.radius_join(df).collect()}
    want = {(a, b) for i, b in enumerate(words) for a in words[:i] if abs(len(a) - len(b)) <= 1 and brute_distance(a, b) <= 1}
    assert got == want


SCHEMA = "id string, name string, type string, ingested_at timestamp_ntz, unit string, kind string"
FORMS = [(1, "Bill", "William"), (2, "Bill", "Billy"), (3, "Ltd.", "Limited"), (4, "Inst.", "Institute")]


def pairs(spark, rows):
    nodes = spark.createDataFrame([(i, n, t, None, "x", "y") for i, n, t in rows], SCHEMA)
    forms = spark.createDataFrame(FORMS, "form_id bigint, short_form string, full_form string")
    return {(r.node_a, r.node_b) for r in names.variant_pairs(names.entities(nodes, forms)).collect()}


def test_variants(spark):
    rows = [
        ("a1", "William Tudivinan", "PERSON"), ("a2", "Tudivinan, Bill", "AUTHOR"), ("a3", "DR. WILLIAM K. TUDIVNIAN", "person"), ("a4", "Tudivinan Wiliam", "CONCEPT"), ("a5", "W. Tudivinan", "PERSON"),
        ("b1", "Carmen Tudivinan", "PERSON"), ("c1", "Ardudeboix Tunnel Limited", "ORG"), ("c2", "The Ardudeboix Tunnel Ltd", "COMPANY"), ("c3", "ArdudeboixTunnel Ltd.", "organization"), ("d1", "Ardudeboix Bridge Limited", "ORG"),
        ("x1", None, "PERSON"), ("x2", "", "PERSON"), ("x3", "Single", "PERSON"), ("x4", "y" * 30000 + " Tudivinan", "PERSON"), ("a1", "William Tudivinan", "PERSON"), (None, "William Tudivinan", "PERSON"), ("k1", "plain concept", "CONCEPT"), ("k2", "plain concept", "CONCEPT"), ("x5", "Null Type", None),
    ]
    got = pairs(spark, rows)
    want = {(a, b) for g in (["a1", "a2", "a3", "a4", "a5"], ["c1", "c2", "c3"]) for a in g for b in g if a < b}
    assert got == want


def test_empty(spark):
    assert pairs(spark, []) == set()


@pytest.mark.parametrize(("name", "kind", "want"), [("Dr. Ana López", "PERSON", ["ana", "lopez"]), ("López, Ana M.", None, ["ana", "lopez"]), ("M. Lopez", "person", ["lopez"]), ("Inst. of Vision, Kor", "x", ["kor", "vision"]), ("Vision Institute Kor", "x", ["kor", "vision"])])
def test_parse(name, kind, want):
    assert names.parse_name(name, kind, {"inst": "institute"})["words"] == want


GIVEN = ["Farida", "Abigail", "Margaret", "Ferdinand", "Diego", "Soren", "Emeka", "Goran", "Octavia", "Leopold"]


def crowd(times):
    """Persons of 40 families and of a hot one, ``times`` times over; one Abigail in 40 is also written Abigali."""
    rows = []
    for k in range(times):
        for f in range(40):
            family = f"{'bdfgklmnprstvz'[f % 14]}ou{'bdfgklmnprstvz'[f // 14]}xe{'bdfgklmnprstvz'[(f * 5 + 3) % 14]}k{k:03}".replace("0", "aa").replace("1", "ee").replace("2", "ii").replace("3", "oo").replace("4", "uu").replace("5", "ya").replace("6", "ye").replace("7", "yi").replace("8", "yo").replace("9", "yu")
            rows += [(f"{k}-{f}-{g}", f"{g} {family}", "PERSON") for g in GIVEN]
            if f % 40 == 0:
                rows.append((f"typo-{k}-{f}", f"Abigali {family}", "PERSON"))
    return rows


@pytest.mark.parametrize("times", [1, 10])
def test_spellings_are_linked_at_any_size(spark, times):
    """A misspelt given name has many partners in a large table, and is a misspelt one still."""
    rows = crowd(times)
    got = pairs(spark, rows)
    assert got == {(f"{k}-0-Abigail", f"typo-{k}-0") for k in range(times)}


def test_spellings_of_a_hot_family(spark):
    """A misspelt hot family has many partners; another family one letter off that has members enough is its own."""
    rows = [(f"h{k}-{g}", f"{g} Tudivinan", "PERSON") for k in range(20) for g in GIVEN] + [(f"t-{g}", f"{g} Tudivnian", "PERSON") for g in GIVEN[:4]]
    rows += [(f"o{k}-{g}", f"{g} Tudivinar", "PERSON") for k in range(4) for g in GIVEN]
    got = pairs(spark, rows)
    assert {("h0-" + g, "t-" + g) for g in GIVEN[:4]} <= got
    assert not [p for p in got if p[0][0] + p[1][0] in ("ho", "ot")]


def test_apart_by_share():
    assert [names._apart(*x) for x in ((3, 58), (30, 3000), (3, 23), (9, 40), (3000, 10000), (0, 5), (14, -1))] == [False, False, False, True, True, False, True]


def test_wrong_type_in_a_hot_family(spark):
    """A member of a hot family whose type is wrong is found, though both its words are common."""
    rows = [(f"h{k:03}", f"{GIVEN[k % 10]} Tudivinan", "PERSON") for k in range(10)]
    rows += [(f"g{k:03}", f"{w} {GIVEN[0]}", "CONCEPT") for k, w in enumerate(a + b + "xe" for a in "bdfgk" for b in ("ol", "ur", "am", "en", "ip"))]
    rows += [(f"f{k:03}", f"{a}{b}ox Tudivinan", "CONCEPT") for k, (a, b) in enumerate((a, b) for a in "bdfgk" for b in ("ol", "ur", "am", "en", "ip"))]
    got = pairs(spark, [*rows, ("weak", f"Tudivinan, {GIVEN[0]}", "CONCEPT")])
    assert ("h000", "weak") in got
    assert not [p for p in got if p[0][0] in "fg" and p[1][0] in "fg"]


def test_divided_words_give_the_same(spark, monkeypatch):
    """Names of a frequent word, divided among tasks, meet as they do in one."""
    rows = [(f"h{k}-{g}", f"{g} Tudivinan", "PERSON") for k in range(2) for g in GIVEN] + [("t1", "Tudivnian, Goran", "PERSON"), ("t2", "O. Tudivinan", "PERSON"), ("o1", "Goran Marupexe", "PERSON"), ("o2", "Marupexe Gorann", "CONCEPT")]
    rows += [(f"c{k}", f"Ardudeboix {w} Ltd", "ORG") for k, w in enumerate(["Tunnel", "Bridge", "Harbour", "Tunnell"])]
    whole = pairs(spark, rows)
    monkeypatch.setattr(names, "HOT_NAMES", 2)
    assert pairs(spark, rows) == whole and {("h0-Goran", "t1"), ("o1", "o2"), ("c0", "c3")} <= whole


def test_short_names_are_learned_from_large_families(spark):
    rng = random.Random(8)
    large = [(f"big{i}", n) for i in range(4) for n in ["alexander", "sandro", *(f"x{i}y{j}" for j in range(60))] if (i, n) != (3, "alexander")]
    small = [(f"fam{i}", rng.choice(["maria", "otto", "gerda", "wilhelmina", "mina", "ott"])) for i in range(60)]
    rows = [("person", *x) for x in large + small] + [("person", f"fam{i}", n) for i in range(6) for n in ("bert", "hubert")]
    held = {}
    for _, f, g in rows:
        held.setdefault(g, set()).add(f)
    total = len({f for _, f, _ in rows})
    want = {(g, w) for g, x in held.items() for w, y in held.items() if len(g) < len(w) and len(y) >= 3 and len(x & y) >= 2 and 2 * len(x & y) >= len(x) and len(x & y) * total >= 8 * len(x) * len(y) and len(set(g) & set(w)) >= 2}
    found = names.learned_short_names(spark.createDataFrame(rows, "kind string, p1 string, p2 string"), spark.createDataFrame([("bob", "robert")], "short string, long string"))
    assert {tuple(r) for r in found.collect()} == want | {("bob", "robert")}
    assert {("sandro", "alexander"), ("bert", "hubert")} <= want
