"""Variant spellings of names typed by people (problem 5).

The words of all names form a metric space under the Damerau-Levenshtein distance (a true metric: insertions, deletions,
substitutions and swaps of neighbours).  Each word goes to its nearest pivot; words that the triangle inequality lets lie
within the radius of a word of another cell are replicated there; inside each cell an exact radius join runs.  Names that
share a similar rare word are then compared part by part.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from quillgraph.operators.components import connected_components
from quillgraph.operators.pairs import pairs_within
from quillgraph.session import cut, lookup

RADIUS = 1
#: Pivots: PIVOT_FACTOR times the cube root of the number of words, within these bounds.
PIVOT_FACTOR, LEAST_PIVOTS, MOST_PIVOTS = 8, 16, 4096
#: Longer words meet by their first or last END characters instead of by pivots: one edit cannot touch both.
LONGEST_WORD, END = 48, 20
#: Names that share a word and are compared by one task; words of more names are divided.
HOT_NAMES = 2048
#: Home words of a cell that one task holds; larger cells are divided.
CELL_PART = 4096
#: A word is established as a name of its own if so many different names have it.
ESTABLISHED = 3
#: Of two established words, the rarer may still be a spelling of the other if it makes up at most this share of the
#: other's nodes (one certain spelling mistake), plus so many standard deviations of a count as small as that.
MISSPELT, DEVIATIONS = 0.03, 3
#: The hand-made table of short forms is read whole up to so many entries; a larger one is refused.
MOST_VOCABULARY = 200_000

# Titles and particles that are no part of a name, words that name the form of a body, and spellings of types.
TITLES = {"dr", "prof", "professor", "mr", "mrs", "ms", "miss", "sir", "herr", "frau", "mme", "mlle", "mx", "phd", "md", "jr", "sr"}
PARTICLES = {"the", "of", "for", "and", "in", "de", "der", "des", "du", "la", "le", "el", "fur"}
FORMS = {"company", "incorporated", "limited", "laboratory", "university", "institute", "association", "foundation", "corporation", "society", "group", "council", "academy", "college", "agency", "centre", "bureau", "trust"}
USUAL_SHORT_FORMS = {
    "co": "company", "inc": "incorporated", "ltd": "limited", "lab": "laboratory", "labs": "laboratory", "laboratories": "laboratory", "uni": "university", "univ": "university", "inst": "institute", "institut": "institute", "assn": "association", "assoc": "association",
    "fdn": "foundation", "found": "foundation", "corp": "corporation", "soc": "society", "acad": "academy", "center": "centre", "ctr": "centre",
}
PERSON_TYPES = ["person", "people", "persons", "human", "author", "individual", "per"]
BODY_TYPES = ["organization", "organisation", "org", "company", "organizations", "organisations", "institution", "corporation", "firm"]


def plain(text: str) -> str:
    """Letters without marks, in lower case; a capital after a small letter opens a new word."""
    text = re.sub(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ])", " ", unicodedata.normalize("NFKC", text))
    text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("đ", "d").replace("ı", "i").casefold()


def codes(words: list[str], width: int, alphabet: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Words as rows of character codes, and their lengths."""
    out = np.zeros((len(words), width), np.int16)
    for i, w in enumerate(words):
        out[i, : len(w)] = [alphabet.setdefault(c, len(alphabet) + 1) for c in w]
    return out, np.fromiter(map(len, words), np.int64, len(words))


def edit_distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, letters: int) -> np.ndarray:
    """Damerau-Levenshtein distances of many pairs at once (unrestricted, so the triangle inequality holds)."""
    n, wa, wb = len(a), a.shape[1], b.shape[1]
    most = wa + wb
    d = np.full((wa + 2, wb + 2, n), most, np.int16)
    for i in range(wa + 1):
        d[i + 1, 1] = i
    for j in range(wb + 1):
        d[1, j + 1] = j
    seen = np.zeros((letters + 1, n), np.int64)
    every = np.arange(n)
    for i in range(1, wa + 1):
        x = a[:, i - 1].astype(np.int64)
        last = np.zeros(n, np.int64)
        for j in range(1, wb + 1):
            y = b[:, j - 1].astype(np.int64)
            same = x == y
            k = seen[y, every]
            swap = d[k, last, every] + (i - k - 1) + 1 + (j - last - 1)
            best = np.minimum(d[i, j] + ~same, np.minimum(d[i + 1, j], d[i, j + 1]) + 1)
            d[i + 1, j + 1] = np.minimum(best, swap)
            last[same] = j
        seen[x, every] = i
    return d[la + 1, lb + 1, every].astype(np.int64)


def distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance of one pair."""
    alphabet: dict[str, int] = {}
    ca, la = codes([a], max(1, len(a)), alphabet)
    cb, lb = codes([b], max(1, len(b)), alphabet)
    return int(edit_distances(ca, la, cb, lb, len(alphabet))[0])


def within_one(a: str, b: str) -> bool:
    """Whether the Damerau-Levenshtein distance is 0 or 1, in linear time."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(a) < len(b):
        return a[i:] == b[i + 1 :]
    return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


@pandas_udf(BooleanType())
def close_by(a: pd.Series, b: pd.Series) -> pd.Series:
    """See :func:`within_one`."""
    return pd.Series([within_one(x, y) for x, y in zip(a, b)], dtype=bool)


def _to_pivots(words: list[str], pivots: list[str]) -> np.ndarray:
    """Distances of each word to each pivot."""
    alphabet: dict[str, int] = {}
    a, la = codes(words, max(map(len, words)), alphabet)
    out = np.empty((len(words), len(pivots)), np.int64)
    for k, p in enumerate(pivots):
        b, lb = codes([p], max(1, len(p)), alphabet)
        out[:, k] = edit_distances(a, la, np.repeat(b, len(words), 0), np.repeat(lb, len(words)), len(alphabet))
    return out


def _histograms(words: list[str]) -> np.ndarray:
    out = np.zeros((len(words), 40), np.int8)
    for i, w in enumerate(words):
        for c in w:
            out[i, ord(c) % 40] += 1
    return out


def placed(words: DataFrame, pivots: list[str], radius: int) -> DataFrame:
    """``(cell, role, word, d)``: each word in its home cell (role 0), and in every cell whose words it may lie near (1).

    If x in cell p and y are within the radius, d(y, p) <= d(x, p) + r <= d(x, home(y)) + r <= d(y, home(y)) + 2 r.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                names = batch.column(0).slice(at, 2000).to_pylist()
                d = _to_pivots(names, pivots)
                home = d.argmin(axis=1)
                nearest = d[np.arange(len(names)), home]
                i, cell = np.nonzero(d <= (nearest + 2 * radius)[:, None])
                cells = np.concatenate((home, cell))
                who = np.concatenate((np.arange(len(names)), i))
                role = np.concatenate((np.zeros(len(names), np.int32), np.ones(len(i), np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(role), pa.array([names[k] for k in who.tolist()], pa.string()), pa.array(d[who, cells].astype(np.int32))], names=["cell", "role", "word", "d"])

    return words.select("word").mapInArrow(run, "cell int, role int, word string, d int")


def radius_join(words: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b, d)``, ``a < b``: all pairs of different words within the radius, exactly.

    ``words`` has a column ``word``; nulls, empty and repeated words are left out.
    """
    every = cut(words.select("word").where("length(word) > 0").distinct(), "p5-words")
    near = pivot_join(every.where(F.length("word") <= LONGEST_WORD), radius)
    # a pair with a long word: both have LONGEST_WORD - radius characters or more, so the edits leave one end as it is
    ends = every.where(F.length("word") >= LONGEST_WORD - radius).select("word", F.explode(F.array(F.concat(F.lit("<"), F.substring("word", 1, END)), F.concat(F.lit(">"), F.substring("word", -END, END)))).alias("end"))
    long = pairs_within(ends, ["end"], "word").where(F.greatest(F.length("a"), F.length("b")) > LONGEST_WORD).where(F.abs(F.length("a") - F.length("b")) <= radius).select("a", "b").distinct()
    return near.unionByName(long.where(close_by("a", "b")).select("a", "b", F.lit(1).alias("d")))


def pivot_join(words: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(a, b, d)``, ``a < b``: all pairs of different words ``(word)`` of at most LONGEST_WORD characters within the radius.

    ``words`` is read three times, so it should be a table.
    """
    n = words.count()
    count = min(MOST_PIVOTS, max(LEAST_PIVOTS, round(PIVOT_FACTOR * n ** (1 / 3))))
    pivots = [r.word for r in words.orderBy(F.xxhash64("word"), "word").limit(count).collect()]
    if not pivots:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b"), F.lit(0).alias("d"))
    cells = cut(placed(words.repartition(max(2, min(512, n // 1000))), pivots, radius), "p5-cells")
    # at most one row per pivot; a cell with many home words is divided, and its other words go to all parts
    parts = cells.where("role = 0").groupBy("cell").agg(F.ceil(F.count("*") / CELL_PART).cast("int").alias("parts"))
    rows = cells.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, other = None, [], []

        def compare() -> tuple[list[str], list[str], list[int]]:
            if not home or not other:
                return [], [], []
            alphabet: dict[str, int] = {}
            hw, hd = [w for w, _ in home], np.array([d for _, d in home])
            ow, od = [w for w, _ in other], np.array([d for _, d in other])
            width = max(map(len, hw + ow))
            hc, hl = codes(hw, width, alphabet)
            oc, ol = codes(ow, width, alphabet)
            hh, oh = _histograms(hw), _histograms(ow)
            left, right = [], []
            for at in range(0, len(hw), 256):
                # distance to the pivot and length differ by at most the radius, and so do the bags of letters
                near = (np.abs(hd[at : at + 256, None] - od) <= radius) & (np.abs(hl[at : at + 256, None] - ol) <= radius)
                i, j = np.nonzero(near)
                diff = hh[i + at].astype(np.int16) - oh[j]
                ok = np.maximum(np.where(diff > 0, diff, 0).sum(1), np.where(diff < 0, -diff, 0).sum(1)) <= radius
                left.append(i[ok] + at)
                right.append(j[ok])
            i, j = np.concatenate(left), np.concatenate(right)
            if not len(i):
                return [], [], []
            d = edit_distances(hc[i], hl[i], oc[j], ol[j], len(alphabet))
            keep = np.flatnonzero((d <= radius) & (d > 0))
            return [hw[k] for k in i[keep]], [ow[k] for k in j[keep]], d[keep].tolist()

        def made(result: tuple[list[str], list[str], list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(result[0], pa.string()), pa.array(result[1], pa.string()), pa.array(result[2], pa.int32())], names=["a", "b", "d"])

        for batch in batches:
            for cell, part, role, word, d in zip(*(c.to_pylist() for c in batch.columns)):
                if (cell, part) != key:
                    yield made(compare())
                    key, home, other = (cell, part), [], []
                (other if role else home).append((word, d))
                if len(other) >= 4 * CELL_PART:
                    yield made(compare())
                    other = []
        yield made(compare())

    found = rows.select("cell", "part", "role", "word", "d").repartition("cell", "part").sortWithinPartitions("cell", "part", "role").mapInArrow(run, "a string, b string, d int")
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("d").alias("d"))


_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*\.?")
PARSED = "id string, kind string, weak boolean, words array<string>, dotted array<string>, initial string, comma boolean, form string"


def parse_name(name: str | None, kind: str | None, short_bodies: dict[str, str]) -> dict | None:
    """A name's words, the form of a body, the initial of a person; None where there is nothing to compare."""
    if not name or not name.strip():
        return None
    text = plain(name)
    before, comma, after = text.partition(",")
    tokens = _TOKEN.findall(text)
    said = re.sub(r"[^a-z]", "", (kind or "").lower())
    form, rest, dotted, form_at = None, [], [], 0
    for token in tokens:
        w = token.rstrip(".").replace("'", "").replace("’", "")
        if w in short_bodies or w in FORMS:
            form, form_at = form or short_bodies.get(w, w), len(rest)
        elif w not in PARTICLES:
            rest.append(w)
            if token.endswith(".") and len(w) > 1:
                dotted.append(w)
    if said in PERSON_TYPES:
        form, rest = None, [w for w in (t.rstrip(".").replace("'", "").replace("’", "") for t in tokens) if w not in PARTICLES]
    if form or said in BODY_TYPES:
        words = [w for w in rest if len(w) > 1]
        # the proper name leads, but for "form of field, name" and "field form name"; without a form its place is open
        if form and len(words) > 1 and (comma or 0 < form_at < len(rest)):
            words = [words[-1], *words[:-1]]
        return {"kind": "body", "weak": False, "words": words, "dotted": dotted, "initial": None, "comma": bool(form), "form": form} if words else None
    words = [w for w in rest if w not in TITLES]
    longs, shorts = [w for w in words if len(w) > 1], [w for w in words if len(w) == 1]
    if not longs or (len(longs) == 1 and not shorts):
        return None
    if comma and len(longs) > 1:
        family = [w for w in longs if w in _TOKEN.findall(before)] or longs[:1]
        given = [w for w in longs if w not in family] or longs[1:]
        longs = [given[0], family[-1]]
    elif len(longs) > 2:
        longs = [longs[0], longs[-1]]
    return {"kind": "person", "weak": said not in PERSON_TYPES, "words": longs, "dotted": [], "initial": shorts[0] if len(longs) == 1 else None, "comma": bool(comma), "form": None}


def parsed(nodes: DataFrame, short_bodies: dict[str, str]) -> DataFrame:
    """The parsed names of all nodes (the earliest row of each id), as :data:`PARSED`."""
    one = nodes.where("id IS NOT NULL AND name IS NOT NULL").groupBy("id").agg(F.min_by(F.struct("name", "type"), F.struct("ingested_at", "name", "type")).alias("x")).select(F.col("id").cast("string").alias("id"), "x.name", "x.type")
    schema = pa.schema([("id", pa.string()), ("kind", pa.string()), ("weak", pa.bool_()), ("words", pa.list_(pa.string())), ("dotted", pa.list_(pa.string())), ("initial", pa.string()), ("comma", pa.bool_()), ("form", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, name, kind in zip(*(c.to_pylist() for c in batch.columns)):
                found = parse_name(name, kind, short_bodies)
                if found:
                    rows.append(found | {"id": key})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return one.mapInArrow(run, PARSED)


def short_forms(forms: DataFrame) -> tuple[dict[str, str], DataFrame]:
    """Short forms of bodies' forms, and ``(short, long)`` of given names (a short form may stand for several) from a
    hand-made table of at most MOST_VOCABULARY rows."""
    rows = forms.where("short_form IS NOT NULL AND full_form IS NOT NULL").select("short_form", "full_form").distinct().limit(MOST_VOCABULARY + 1).collect()
    if len(rows) > MOST_VOCABULARY:
        raise ValueError(f"more than {MOST_VOCABULARY} short forms")
    bodies = dict(USUAL_SHORT_FORMS)
    given = set()
    for r in rows:
        short, full = plain(r.short_form).strip().rstrip("."), plain(r.full_form).strip()
        if full in FORMS:
            bodies[short] = full
        elif short and full:
            given.add((short, full))
    return bodies, forms.sparkSession.createDataFrame(sorted(given), "short string, long string")


def body_parts(bodies: DataFrame) -> DataFrame:
    """``(id, part, field)`` of bodies: the proper name and the field, with run-together words divided and abbreviated
    fields written out by the words that other bodies use."""
    words = bodies.select("id", F.explode("words").alias("w"))
    counts = words.groupBy("w").agg(F.countDistinct("id").alias("n"))
    known = cut(counts.where((F.col("n") >= ESTABLISHED) & (F.length("w") >= 4)).select("w", "n"), "p5-fields")
    # one word: the longest known field that it ends with is divided off
    single = bodies.where("size(words) = 1").select("id", F.col("words")[0].alias("w"))
    ends = single.where("length(w) >= 8").select("id", "w", F.explode(F.sequence(F.lit(5), F.length("w") - 3)).alias("at")).select("id", F.expr("substr(w, 1, at - 1)").alias("part"), F.expr("substr(w, at)").alias("end"))
    glued = ends.join(known.withColumnRenamed("w", "end"), "end").groupBy("id").agg(F.max_by(F.struct("part", F.col("end").alias("field")), F.length("end")).alias("x")).select("id", "x.part", "x.field")
    alone = single.join(glued, "id", "left_anti").select("id", F.col("w").alias("part"), F.lit(None).cast("string").alias("field"))
    # several words: abbreviations are written out; the word that goes with the fewest others is the proper name
    starts = known.select("w", "n", F.explode(F.sequence(F.lit(3), F.length("w") - 2)).alias("k")).select(F.expr("substr(w, 1, k)").alias("short"), "w", "n").groupBy("short").agg(F.max_by("w", F.struct("n", "w")).alias("long"))
    several = bodies.where("size(words) > 1").select("id", "dotted", "comma", F.posexplode("words").alias("k", "w")).withColumn("dot", F.expr("array_contains(dotted, w)"))
    several = several.join(known.select("w", F.lit(True).alias("whole")), "w", "left").join(starts.withColumnRenamed("short", "w"), "w", "left")
    several = cut(several.select("id", "k", F.when(F.col("dot") | F.col("whole").isNull(), F.coalesce("long", "w")).otherwise(F.col("w")).alias("w"), (F.col("comma") & (F.col("k") > 0)).alias("later"), "dot"), "p5-several")
    beside = several.groupBy("id").agg(F.collect_set("w").alias("all")).select("id", F.explode("all").alias("w"), F.size("all").alias("size"), "all").select("id", "w", F.explode(F.array_except("all", F.array("w"))).alias("o"))
    others = beside.groupBy("w").agg(F.countDistinct("o").alias("n"))
    several = several.join(others, "w", "left").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("later", "dot", F.coalesce("n", F.lit(0)).alias("n"), "k", "w"))).alias("s"))
    several = several.select("id", F.col("s")[0]["w"].alias("part"), F.array_join(F.array_sort(F.transform(F.slice("s", F.lit(2), F.size("s") - 1), lambda x: x["w"])), " ").alias("field"))
    return glued.unionByName(alone).unionByName(several)


def learned_short_names(rows: DataFrame, given: DataFrame) -> DataFrame:
    """``(short, long)`` of given names with those that the names themselves show: a shorter given name most of whose
    families also hold one certain longer given name, far more often than chance would have it.

    A longer name that most of a shorter one's n families hold, two at least, misses so few of them that any
    n - max(2, n / 2) + 1 of them have it.  So each name's smallest families, that many, propose all its pairs, and all
    families are counted for them, whatever their size.  The two names have two letters in common at least.
    """
    held = cut(rows.where("kind = 'person' AND p2 IS NOT NULL").select(F.col("p1").alias("family"), F.col("p2").alias("g")).distinct(), "p5-given")
    total = held.select("family").distinct().count()
    size = cut(held.groupBy("g").agg(F.count("*").alias("n")), "p5-given-sizes")
    # the bounds below leave no pair with more families than this
    able = held.join(size.where((F.col("n") >= 2) & (8 * F.col("n") <= total)), "g")
    families = held.groupBy("family").agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy("g").orderBy("c", "family"))
    some = able.join(families, "family").withColumn("place", place).where(F.col("place") <= F.col("n") - F.greatest(F.lit(2), F.ceil(F.col("n") / 2)) + 1).select("family", "g", "n")
    longer = able.where(F.col("n") >= ESTABLISHED).select("family", F.col("g").alias("long"), F.col("n").alias("m"))
    letters = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    met = some.join(longer, "family").where("length(g) < length(long) AND 2 * m >= n")
    proposed = met.select("g", "long").distinct().where(F.size(F.array_intersect(letters("g"), letters("long"))) >= 2)
    pairs = proposed.join(held, "g").join(held.withColumnRenamed("g", "long"), ["family", "long"]).groupBy("g", "long").agg(F.count("*").alias("c"))
    rated = pairs.where("c >= 2").join(size, "g").join(size.select(F.col("g").alias("long"), F.col("n").alias("m")), "long").where(F.col("m") >= ESTABLISHED).where(F.col("c") * 2 >= F.col("n")).where(F.col("c") * total >= 8 * F.col("n") * F.col("m"))
    return given.unionByName(rated.select(F.col("g").alias("short"), "long")).distinct()


def units(nodes: DataFrame, short_bodies: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """``(id, unit)`` of each node, and the different names ``(unit, kind, p1, p2, initial, swap, form, weak)``.

    p1 is the family or proper name, p2 the given name or the field (null where only an initial or nothing is known).
    """
    names = cut(parsed(nodes, short_bodies), "p5-parsed")
    persons = names.where("kind = 'person'").select("id", "kind", "weak", F.when(F.size("words") > 1, F.col("words")[1]).otherwise(F.col("words")[0]).alias("p1"), F.when(F.size("words") > 1, F.col("words")[0]).alias("p2"), "initial", (~F.col("comma") & (F.size("words") > 1)).alias("swap"), F.lit(None).cast("string").alias("form"))
    bodies = names.where("kind = 'body'")
    parts = body_parts(bodies)
    bodies = bodies.select("id", "kind", "weak", "form").join(parts, "id").select("id", "kind", "weak", F.col("part").alias("p1"), F.col("field").alias("p2"), F.lit(None).cast("string").alias("initial"), F.lit(False).alias("swap"), "form")
    rows = persons.unionByName(bodies)
    unit = F.concat_ws("|", "kind", "p1", F.coalesce("p2", F.lit("")), F.coalesce("initial", F.lit("")), F.col("swap").cast("string"), F.coalesce("form", F.lit("")))
    rows = cut(rows.withColumn("unit", unit), "p5-units")
    return rows.select("id", "unit"), rows.groupBy("unit", "kind", "p1", "p2", "initial", "swap", "form").agg(F.min("weak").alias("weak"), F.count("*").alias("n_nodes"))


def _close(a: str, b: str) -> bool:
    return within_one(a, b) if RADIUS == 1 else abs(len(a) - len(b)) <= RADIUS and distance(a, b) <= RADIUS


def _apart(ea: float, eb: float) -> bool:
    """Whether two words within the radius are different names rather than spellings of one.

    Given are the nodes of each: 0 for words that are not established, -1 for words mostly of names that are no persons.
    The share decides, so the answer stays the same if all rows come many times over.
    """
    if not ea or not eb:
        return False
    rare, common = sorted((ea, eb))
    return rare < 0 or rare > MISSPELT * common + DEVIATIONS * (MISSPELT * common) ** 0.5


def _given_alike(a: str | None, ia: str | None, b: str | None, ib: str | None, ea: float, eb: float, fa: dict[str, float], fb: dict[str, float]) -> bool:
    if a is None or b is None:
        left = {ia} if a is None else {a[0], *(x[0] for x in fa)}
        right = {ib} if b is None else {b[0], *(x[0] for x in fb)}
        return bool(left & right)
    if a == b:
        return True
    xs, ys = [a, *fa], [b, *fb]
    if set(xs) & set(ys):
        return True
    short, long = sorted((a, b), key=len)
    if len(long) - len(short) >= 2 and (len(short) >= 3 and long.startswith(short) or len(short) >= 4 and long.endswith(short)):
        return True
    if min(len(a), len(b)) < 3:
        return False
    # a full form is judged by its own nodes, or by those of its short form where it does not occur
    return any(_close(x, y) and not _apart(ea if x == a else fa.get(x) or ea, eb if y == b else fb.get(y) or eb) for x in xs for y in ys)


def _alike(x: tuple, y: tuple) -> bool:
    """Whether two names may stand for the same: family or proper names within the radius, and given names, initials,
    fields and forms that agree.  The last two entries of each are the full forms of its two words, with the nodes of each
    as :func:`_apart` takes them."""
    (kind, p1, p2, initial, swap, form, e1, e2, x1, x2), (_, q1, q2, jnitial, twap, gorm, f1, f2, y1, y2) = x, y
    near = lambda a, b, ea, eb: a == b or (min(len(a), len(b)) >= 4 and not _apart(ea, eb) and _close(a, b))
    if kind == "body":
        if not near(p1, q1, e1, f1) or (form and gorm and form != gorm):
            return False
        if p2 is None or q2 is None or near(p2, q2, e2, f2):
            return True
        short, long = sorted((p2, q2), key=len)
        return len(short) >= 3 and len(long) - len(short) >= 2 and long.startswith(short)
    if near(p1, q1, e1, f1) and _given_alike(p2, initial, q2, jnitial, e2, f2, x2, y2):
        return True
    # the given name may stand last, in either of the two
    if swap and p2 and near(p2, q1, e2, f1) and _given_alike(p1, None, q2, jnitial, e1, f2, x1, y2):
        return True
    return bool(twap and q2 and near(p1, q2, e1, f2) and _given_alike(p2, initial, q1, None, e2, f1, x2, y1))


def _related(near: DataFrame, counts: DataFrame, given: DataFrame) -> DataFrame:
    """``(a, b)``, both ways: words that may be the same part of a name: within the radius, a given name and its short
    form (or a misspelling of it), or one word the beginning or end of the other.

    All ways in which two parts can agree are here, so names that agree meet by either of their parts, whichever is rarer.
    """
    sides = lambda df: df.select("a", "b").unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    close = sides(near)
    # a short form and its full form, and two short forms of the same full form
    nick = given.select(F.col("short").alias("a"), F.col("long").alias("b")).unionByName(sides(pairs_within(given, ["long"], "short"))).distinct()
    spelled = nick.join(close.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
    words = counts.where("length(w) >= 3").select("w").distinct()
    most = F.least(F.length("w") - 2, F.lit(LONGEST_WORD))  # beginnings and ends of up to LONGEST_WORD characters
    parts = F.concat(F.transform(F.sequence(F.lit(3), most), lambda k: F.substring("w", F.lit(1), k)), F.transform(F.sequence(F.lit(4), F.greatest(F.lit(4), most)), lambda k: F.substring("w", -k, k)))
    inner = words.where("length(w) >= 5").select(F.col("w").alias("a"), F.explode(F.array_distinct(parts)).alias("b")).where("a <> b").join(words.select(F.col("w").alias("b")), "b", "left_semi")
    return sides(near.select("a", "b").unionByName(nick).unionByName(spelled).unionByName(inner.select("a", "b"))).where("a <> b").distinct()


def entities(nodes: DataFrame, forms: DataFrame) -> DataFrame:
    """``(id, kind, entity)`` of every person and organisation among the nodes; an entity is named by one of its units.

    Names that give only an initial, or no field, join the one entity that they fit; where several fit they stay alone.
    Null, empty and one-word names of persons have no row; repeated rows of an id count once; an empty table gives no rows.
    """
    short_bodies, given = short_forms(forms)
    of_node, names = units(nodes, short_bodies)
    names = cut(names, "p5-names")
    given = cut(learned_short_names(names, given), "p5-short-forms")
    held = names.select("unit", "kind", F.explode(F.array(F.struct(F.col("p1").alias("w"), F.col("p2").alias("o")), F.struct(F.col("p2").alias("w"), F.col("p1").alias("o")))).alias("h"), "weak", "n_nodes").select("unit", "kind", "weak", "n_nodes", "h.w", "h.o").where("w IS NOT NULL")
    counts = cut(held.groupBy("kind", "w").agg(F.countDistinct("o").alias("others"), F.countDistinct("unit").alias("n"), F.sum("n_nodes").alias("nodes"), F.sum(F.when(~F.col("weak"), F.col("n_nodes")).otherwise(0)).alias("strong")), "p5-counts")
    near = cut(radius_join(held.select(F.col("w").alias("word"))), "p5-radius")
    both = cut(_related(near, counts, given), "p5-near")
    mass = counts.join(both.select(F.col("a").alias("w"), F.col("b").alias("v")), "w", "left").join(counts.select("kind", F.col("w").alias("v"), F.col("n").alias("m")), ["kind", "v"], "left").groupBy("kind", "w").agg((F.first("n") + F.coalesce(F.sum("m"), F.lit(0))).alias("mass"), F.first("others").alias("others"), F.first("nodes").alias("nodes"), F.first("strong").alias("strong"))
    known = F.when(F.col("others") < ESTABLISHED, 0.0).when(F.col("strong") * 2 < F.col("nodes"), -1.0).otherwise(F.col("strong").cast("double"))
    mass = mass.select("kind", "w", "mass", known.alias("known"))
    mass = cut(mass, "p5-mass")
    side = lambda p: mass.select("kind", F.col("w").alias(p), F.col("mass").alias(f"{p}_mass"), F.col("known").alias(f"{p}_known"))
    # full forms of given names, with the nodes that have them
    forms_of = given.join(mass.where("kind = 'person'").select(F.col("w").alias("long"), "known"), "long", "left").groupBy("short").agg(F.map_from_entries(F.collect_list(F.struct("long", F.coalesce("known", F.lit(0.0)).alias("known")))).alias("longs"))
    longs = lambda p: forms_of.select(F.lit("person").alias("kind"), F.col("short").alias(p), F.col("longs").alias(f"{p}_longs"))
    full = names.join(side("p1"), ["kind", "p1"], "left").join(side("p2"), ["kind", "p2"], "left")
    full = cut(full.join(longs("p1"), ["kind", "p1"], "left").join(longs("p2"), ["kind", "p2"], "left"), "p5-full")
    key = F.when(F.col("p2").isNull() | (F.col("p1_mass") < F.col("p2_mass")), F.array("p1")).when(F.col("p1_mass") > F.col("p2_mass"), F.array("p2")).otherwise(F.array("p1", "p2"))
    keys = full.select("kind", F.col("unit").alias("x"), F.col("weak").alias("wx"), F.explode(key).alias("a"))
    reach = keys.select("kind", "x", "wx", F.col("a").alias("w")).unionByName(keys.join(both, "a").select("kind", "x", "wx", F.col("b").alias("w"))).distinct()
    # names that only may be persons (other types) are mostly phrases of common words: they look up persons, never each other
    tokens = full.select("kind", F.col("unit").alias("y"), F.col("weak").alias("wy"), F.explode(F.array_distinct(F.array_compact(F.array("p1", "p2")))).alias("w"))
    # the names of a frequent word are divided among tasks, and those that look for it go to all of them
    hot = lookup(tokens.groupBy("kind", "w").agg(F.ceil(F.count("*") / HOT_NAMES).cast("int").alias("parts")).where("parts > 1"), label="p5-hot")
    parts = F.coalesce("parts", F.lit(1))
    tokens = tokens.join(hot, ["kind", "w"], "left").withColumn("part", F.pmod(F.xxhash64("y"), parts).cast("int"))
    reach = reach.join(hot, ["kind", "w"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    reach = reach.withColumn("wy", F.explode(F.when(F.col("wx"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    pairs = reach.join(tokens, ["kind", "w", "part", "wy"]).select("x", "y").where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    cols = ["kind", "p1", "p2", "initial", "swap", "form", "p1_known", "p2_known", "p1_longs", "p2_longs"]
    rich = lambda u: full.select(F.col("unit").alias(u), F.struct(*cols).alias(f"s{u}"), F.col("weak").alias(f"w{u}"))

    @pandas_udf(BooleanType())
    def agree(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        null = lambda v: None if v is None or (isinstance(v, float) and v != v) else v
        rows = lambda t: [(*map(null, r[:-2]), *({} if null(m) is None else dict(m) for m in r[-2:])) for r in t[cols].itertuples(index=False)]
        return pd.Series([_alike(a, b) for a, b in zip(rows(x), rows(y))], dtype=bool)

    met = pairs.join(rich("x"), "x").join(rich("y"), "y").where("NOT (wx AND wy)").where(agree("sx", "sy"))
    links = cut(met.select("x", "y", F.col("sx.p2").isNotNull().alias("fx"), F.col("sy.p2").isNotNull().alias("fy")), "p5-links")
    whole = connected_components(links.where("fx AND fy"), "x", "y")
    base = full.where("p2 IS NOT NULL").select("unit").join(whole.withColumnRenamed("node", "unit"), "unit", "left").select("unit", F.coalesce("component", "unit").alias("entity"))
    base = cut(base, "p5-base")
    partial = links.where("NOT fx AND fy").select(F.col("x").alias("p"), F.col("y").alias("unit")).unionByName(links.where("fx AND NOT fy").select(F.col("y").alias("p"), F.col("x").alias("unit")))
    fits = partial.join(base, "unit").groupBy("p").agg(F.countDistinct("entity").alias("c"), F.min("entity").alias("entity"))
    placed_ = fits.where("c = 1").select(F.col("p").alias("unit"), "entity")
    loose = full.where("p2 IS NULL").select("unit").join(fits.select(F.col("p").alias("unit")), "unit", "left_anti")
    apart = connected_components(links.where("NOT fx AND NOT fy").join(loose.withColumnRenamed("unit", "x"), "x", "left_semi").join(loose.withColumnRenamed("unit", "y"), "y", "left_semi"), "x", "y")
    rest = full.where("p2 IS NULL").select("unit").join(placed_.select("unit"), "unit", "left_anti").join(apart.withColumnRenamed("node", "unit"), "unit", "left").select("unit", F.coalesce("component", "unit").alias("entity"))
    named = base.unionByName(placed_).unionByName(rest)
    # an entity is a person or an organisation by the word of one of its nodes
    said = named.join(full.select("unit", "weak"), "unit").groupBy("entity").agg(F.min("weak").alias("weak")).where("NOT weak").select("entity")
    named = named.join(said, "entity", "left_semi")
    return of_node.join(named, "unit").select("id", F.split("unit", r"\|")[0].alias("kind"), "entity")


def variant_pairs(found: DataFrame) -> DataFrame:
    """``(node_a, node_b)``: all pairs of nodes of the same entity; entities of many nodes are joined in blocks."""
    return pairs_within(found, ["entity"], "id").select(F.col("a").alias("node_a"), F.col("b").alias("node_b"))
