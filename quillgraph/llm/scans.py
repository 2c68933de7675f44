"""Noise in text from scanned pages (problem 1).

A note is from scanned pages if it has ``## Page`` headings.  Its lines are sorted into running text, running headers and
page numbers; words broken at line ends are joined.  Words that the corpus hardly knows look up their repairs in a
symmetric-delete index over the corpus's frequent words; a weighted edit distance with confusion pairs and the counts of
neighbouring words pick the repair.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

from quillgraph.session import cut, lookup

# Characters that stand for a letter after a misreading, and groups of letters that scanners confuse
# (what is read, what is printed).
LOOKALIKES = {
    "@": "a", "0": "o", "1": "l", "!": "i", "|": "l", "5": "s", "$": "s", "2": "z", "6": "b", "9": "g", "8": "b", "(": "c", "€": "e", "3": "e", "7": "t",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ѕ": "s", "ο": "o", "α": "a", "ı": "i",
}
CONFUSIONS = [
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("i", "l"), ("l", "i"), ("l", "t"), ("j", "i"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"), ("o", "a"), ("a", "o"), ("g", "q"), ("q", "g"), ("v", "y"), ("y", "v"), ("s", "a"), ("o", "e"),
    ("li", "h"), ("h", "ti"), ("ii", "u"), ("ri", "n"), ("m", "in"), ("rn", "m"), ("nn", "m"), ("iii", "m"), ("cl", "d"), ("vv", "w"), ("fi", "h"), ("lc", "k"), ("ni", "m"), ("m", "rn"), ("d", "cl"), ("w", "vv"), ("1", "i"), ("!", "l"), ("|", "i"), ("0", "d"), ("n", "ri"), ("u", "ii"), ("h", "li"),
]
_SAME_SHAPE = [("rn", "m"), ("ln", "m"), ("nn", "m"), ("rl", "n"), ("cl", "d"), ("vv", "w"), ("ll", "u"), ("c", "e"), ("f", "t")]
HYPHENS = "-‐‑­¬⁃−"
#: Costs of a known confusion, of one learned from the corpus and of any other edit, and the cost below which a word is
#: taken for a repair.
CONFUSED, LEARNED, OTHER, LIMIT = 0.3, 0.45, 1.0, 1.0
#: A confusion is learned if it explains so many different words of scanned pages, this share of all that one confusion
#: explains (so at most 1 / LEARNED_SHARE are), and so many times the share that it has among the rare words of clean notes.
LEARNED_WORDS, LEARNED_SHARE, LEARNED_RATIO = 5, 0.002, 4
#: Letters on either side of a confusion, and words of clean notes that it is taken to explain beside those it does.
CONFUSION_LETTERS, PRIOR_WORDS = 3, 0.5
#: Words of fewer letters are not repaired.
LEAST_LETTERS = 2
#: A word that clean notes have so often is never suspected.
KNOWN = 3
#: A repair must be so many times as frequent as the word it replaces.
RATIO = 4
PREFIX, DELETES = 7, 2
#: So many words with several possible repairs are sent to all tasks; more are joined.
MOST_WANTED = 200_000

PAGE_HEADING = r"^#{1,6}[ \t]*page[ \t]+[0-9OolIi|ivxlcdm]+[ \t]*\r?$"
_PAGE = re.compile(PAGE_HEADING, re.I)
_NUM = r"(?:[0-9OolIi|S]{1,5}|[ivxlcdm]{1,7}|[IVXLCDM]{1,7})"
_PAGENO = re.compile(rf"^\W*(?:(?:p|pp|pag|page|seite|pagina|página|s|no|nr)\.?\s*)?{_NUM}\W*(?:(?:/|of|von|de|sur)\s*{_NUM}\W*)?$", re.I)
_HAS_DIGIT = re.compile(r"\d")
_ROMAN = re.compile(r"^\W*[ivxlcdm]+\W*$", re.I)
_ENDS = re.compile(rf"^\W*(?:{_NUM}\b[\W_]+)?(.*?)(?:[\W_]+{_NUM})?\W*$")
_LEAD, _TRAIL = "\"'“”„‘’«»([{<*_—–-", ".,;:!?…\"'“”’»)]}>*_—–-"


def fold(text: str) -> str:
    """A text in lower case with lookalikes as the letters they stand for."""
    return "".join(LOOKALIKES.get(c, c) for c in text.lower())


def core(token: str) -> str:
    """A token in lower case without the punctuation around it."""
    return token.lstrip(_LEAD).rstrip(_TRAIL).lower()


def _query(token: str) -> str:
    """The word a token is looked up by: an opening bracket before it may be a misread letter."""
    inner = core(token)
    if token[:1] == "(" and ")" not in token:
        return "(" + inner
    return inner


def _letters(key: str) -> np.ndarray:
    """How often each letter occurs in a key."""
    return np.bincount(np.frombuffer(key.encode("ascii"), np.uint8), minlength=128)[96:123] if key else np.zeros(27, np.int64)


def _near(a: str, b: str, bags: tuple[np.ndarray, np.ndarray] | None = None) -> bool:
    """Equal but for a few characters."""
    if a == b:
        return True
    if not a or not b or abs(len(a) - len(b)) > 2:
        return False
    most = max(1, len(a) // 7)
    if bags is not None and np.abs(bags[0] - bags[1]).sum() > 2 * most:  # each edit changes two counts at most
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1] <= most


def line_kinds(raw: str) -> list[tuple[str, str]]:
    """The kind (``heading``, ``blank``, ``header``, ``pageno`` or ``text``) and the text of each line."""
    lines = [x.rstrip("\r") for x in raw.split("\n")]
    kinds, pages, page = [], defaultdict(list), 0
    titles = set()
    for i, line in enumerate(lines):
        if line.startswith("#"):
            kinds.append("heading")
            if _PAGE.match(line):
                page += 1
            else:
                titles.add(_header_key(line.lstrip("# ")))
        elif not line.strip():
            kinds.append("blank")
        else:
            kinds.append("text")
            if page:
                pages[page].append(i)
    edges: dict[int, list[tuple[int, int]]] = {}
    for p, at in pages.items():
        edges[p] = [(i, min(k, len(at) - 1 - k)) for k, i in enumerate(at)]
    for p, at in edges.items():
        for i, depth in at:
            line = lines[i].strip()
            if _PAGENO.match(line) and (_HAS_DIGIT.search(line) or _ROMAN.match(line)) and depth <= 1:
                kinds[i] = "pageno"
    found: list[tuple[str, np.ndarray, set[int], list[int]]] = []
    for p, at in edges.items():
        for i, depth in at:
            line = lines[i].strip()
            if kinds[i] != "text" or depth > 1:
                continue
            key = _header_key(line)
            if len(key) < 3:
                continue
            bag = _letters(key)
            for other, theirs, seen, where in found:
                if _near(other, key, (theirs, bag)):
                    seen.add(p)
                    where.append(i)
                    break
            else:
                found.append((key, bag, {p}, [i]))
    for key, _, seen, where in found:
        if len(seen) > 1 or any(_near(key, t) for t in titles):
            for i in where:
                kinds[i] = "header"
    return list(zip(kinds, lines))


def _header_key(line: str) -> str:
    if len(line) > 200:
        return ""  # no running header is so long
    inner = _ENDS.match(line.strip())
    inner = inner.group(1) if inner and len(inner.group(1)) > 2 else line
    key = fold(unicodedata.normalize("NFKC", inner)).replace("i", "l")
    for read, meant in _SAME_SHAPE:
        key = key.replace(read, meant)
    return re.sub(r"[^a-z]+", " ", key).strip()


def laid_out(raw: str) -> list[dict]:
    """One record per line: its kind, whether it opens a paragraph, and its tokens with broken words put together."""
    rows = []
    kinds = line_kinds(raw)
    texts = [i for i, (k, _) in enumerate(kinds) if k == "text"]
    follow = dict(zip(texts, texts[1:]))
    skip: set[int] = set()
    at = 0
    closed = True
    for i, (kind, line) in enumerate(kinds):
        row = {"line_no": i + 1, "kind": kind, "start": at, "text": line, "opens": False, "tokens": []}
        at += len(line) + 1
        if kind == "text":
            body = line.strip()
            blank_before = i > 0 and kinds[i - 1][0] == "blank"
            row["opens"] = closed or (line[:2] == "  " and body[:1].isupper()) or (blank_before and not body[:1].islower())
            closed = False
            words = body.split()
            first = 1 if i in skip else 0
            for k, token in enumerate(words[first:], first):
                broken = k == len(words) - 1 and len(token) > 1 and token[-1] in HYPHENS and token[-2:-1].isalnum() and i in follow
                head = None
                if broken:
                    nxt = kinds[follow[i]][1].split()
                    if nxt and (nxt[0].lstrip("(")[:1].isalnum() or nxt[0][:1] in LOOKALIKES):
                        head = nxt[0]
                if head is not None:
                    skip.add(follow[i])
                    row["tokens"].append({"idx": k, "raw": token[:-1] + head, "word": _query(token[:-1] + head), "head": core(token[:-1]) if token[:1] != "(" else _query(token[:-1]), "tail": core("x" + head)[1:], "line2": follow[i] + 1})
                else:
                    row["tokens"].append({"idx": k, "raw": token, "word": _query(token), "head": None, "tail": None, "line2": None})
        elif kind == "heading" and not _PAGE.match(line):
            closed = True
        rows.append(row)
    return rows


#: Marks the text of a chunk that is repaired by itself.
_ALONE = "\x00chunk "
LINE = "note_id string, line_no bigint, kind string, start bigint, text string, opens boolean, tokens array<struct<idx:int,raw:string,word:string,head:string,tail:string,line2:bigint>>"


def is_scanned(column: str = "raw_content") -> Column:
    """Whether a note's text has page headings (``## Page 12``)."""
    return F.col(column).rlike("(?im)" + PAGE_HEADING)


def scanned_lines(notes: DataFrame) -> DataFrame:
    """The lines of all scanned notes (the earliest row of each id), as :data:`LINE`."""
    rows = notes.where("id IS NOT NULL").select("id", "raw_content", "ingested_at")
    # only the texts of ids that occur more than once are aggregated and shuffled
    several = lookup(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), label="p1-several")
    repeated = rows.join(several, "id", "left_semi").where(is_scanned()).groupBy("id").agg(F.min_by("raw_content", F.struct("ingested_at", "raw_content")).alias("raw_content"))
    one = rows.join(several, "id", "left_anti").where(is_scanned()).select("id", "raw_content").unionByName(repeated)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _line_schema()
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [r | {"note_id": k} for k, raw in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for r in laid_out(raw)]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return one.mapInArrow(run, LINE)


def _line_schema() -> pa.Schema:
    token = pa.struct([("idx", pa.int32()), ("raw", pa.string()), ("word", pa.string()), ("head", pa.string()), ("tail", pa.string()), ("line2", pa.int64())])
    return pa.schema([("note_id", pa.string()), ("line_no", pa.int64()), ("kind", pa.string()), ("start", pa.int64()), ("text", pa.string()), ("opens", pa.bool_()), ("tokens", pa.list_(token))])


def clean_counts(notes: DataFrame) -> DataFrame:
    """``(word, n)`` over the notes that are not scanned, added up per batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: Counter = Counter()
            for text in batch.column(0).to_pylist():
                tally.update(text.split())
            words: Counter = Counter()
            for token, n in tally.items():
                words[core(token)] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])

    texts = notes.where(F.col("raw_content").isNotNull() & ~is_scanned()).select("raw_content")
    return texts.mapInArrow(run, "word string, n bigint").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon(notes: DataFrame, lines: DataFrame) -> DataFrame:
    """``(word, n_clean, n_all)``: counts in clean notes and in all; words broken at line ends are not counted."""
    read = lines.select(F.explode("tokens").alias("t")).where("t.line2 IS NULL AND t.word <> ''").groupBy(F.col("t.word").alias("word")).agg(F.count("*").alias("n"))
    both = clean_counts(notes).select("word", F.col("n").alias("n_clean"), F.col("n").alias("n_all")).unionByName(read.select("word", F.lit(0).cast("bigint").alias("n_clean"), F.col("n").alias("n_all")))
    return both.groupBy("word").agg(F.sum("n_clean").alias("n_clean"), F.sum("n_all").alias("n_all"))


def deletes(word: str) -> list[str]:
    """A word's prefix with up to two characters left out."""
    stem = word[:PREFIX]
    out = {stem}
    level = {stem}
    for _ in range(DELETES):
        level = {w[:i] + w[i + 1 :] for w in level for i in range(len(w))}
        out |= level
    return sorted(out)


Pairs = dict[str, list[tuple[str, str, float]]]


def confusion_pairs(learned: list[tuple[str, str]] = ()) -> Pairs:
    """What is read, what is printed and the cost of each confusion, by the last letter read."""
    out: Pairs = defaultdict(list)
    known = {*CONFUSIONS, *LOOKALIKES.items()}
    for read, printed in known:
        out[read[-1]].append((read, printed, CONFUSED))
    for read, printed in learned:
        if (read, printed) not in known:
            out[read[-1]].append((read, printed, LEARNED))
    return out


_PAIRS = confusion_pairs()


def confusion(read: str, word: str) -> str | None:
    """The letters read and those printed in the one place in which two words differ, as ``read>printed``."""
    at = 0
    while at < min(len(read), len(word)) and read[at] == word[at]:
        at += 1
    end = 0
    while end < min(len(read), len(word)) - at and read[len(read) - 1 - end] == word[len(word) - 1 - end]:
        end += 1
    a, b = read[at : len(read) - end], word[at : len(word) - end]
    return f"{a}>{b}" if 0 < len(a) <= CONFUSION_LETTERS and 0 < len(b) <= CONFUSION_LETTERS else None


def weighted_distance(read: str, word: str, limit: float = LIMIT, confusions: Pairs = _PAIRS) -> float:
    """Edit distance from what is read to a word, confusions being cheap."""
    n, m = len(read), len(word)
    cost = [[0.0] * (m + 1) for _ in range(n + 1)]
    for j in range(1, m + 1):
        cost[0][j] = j * OTHER
    for i in range(1, n + 1):
        cost[i][0] = i * OTHER
        x = read[i - 1]
        pairs = confusions.get(x, ())
        for j in range(1, m + 1):
            best = cost[i - 1][j - 1] + (0.0 if x == word[j - 1] else OTHER)
            best = min(best, cost[i - 1][j] + OTHER, cost[i][j - 1] + OTHER)
            for wrong, right, price in pairs:
                a, b = len(wrong), len(right)
                if a <= i and b <= j and (a == 1 or read[i - a : i] == wrong) and word[j - b : j] == right:
                    best = min(best, cost[i - a][j - b] + price)
            cost[i][j] = best
        if min(cost[i]) > limit + CONFUSED:
            return limit + OTHER
    return cost[n][m]


@pandas_udf(ArrayType(StringType()))
def deletes_of(words: pd.Series) -> pd.Series:
    """Keys of the symmetric-delete index."""
    return words.map(deletes)


@pandas_udf(StringType())
def folded(words: pd.Series) -> pd.Series:
    """See :func:`fold`."""
    return words.map(fold)


@pandas_udf(StringType())
def confusion_of(read: pd.Series, word: pd.Series) -> pd.Series:
    """See :func:`confusion`."""
    return pd.Series([confusion(a, b) for a, b in zip(read, word)], dtype=object)


def learned_confusions(met: DataFrame) -> list[tuple[str, str]]:
    """Confusions that the corpus shows: they turn many words that only scanned pages have into frequent ones, far more
    often than they do with the rare words of clean notes, whose likeness to frequent words is no misreading.

    ``met``: ``(word, repair, n_clean)``.  At most 1 / LEARNED_SHARE pairs.
    """
    seen = met.select("word", confusion_of("word", "repair").alias("c"), (F.col("n_clean") > 0).alias("clean")).where("c IS NOT NULL").distinct()
    counts = seen.groupBy("c").agg(F.count_if(~F.col("clean")).alias("n_read"), F.count_if("clean").alias("n_clean"))
    total = seen.agg(F.count_if(~F.col("clean")).alias("all_read"), F.count_if("clean").alias("all_clean"))
    share = F.col("n_read") / F.col("all_read")
    natural = (F.col("n_clean") + PRIOR_WORDS) / (F.col("all_clean") + PRIOR_WORDS / LEARNED_SHARE)
    told = counts.crossJoin(F.broadcast(total)).where((F.col("n_read") >= LEARNED_WORDS) & (share >= LEARNED_SHARE) & (share >= LEARNED_RATIO * natural))  # one row
    return sorted(tuple(r.c.split(">", 1)) for r in told.select("c").collect())


def candidates(lex: DataFrame, lines: DataFrame) -> DataFrame:
    """``(word, repair, cost, n_all)``: possible repairs of every word that the corpus hardly knows.

    Both sides are put under all their delete keys, so words within two edits meet by an equality join.
    """
    partitions = int(lex.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    broken = lines.select(F.explode("tokens").alias("t")).where("t.line2 IS NOT NULL").select(F.col("t.word").alias("word")).distinct()
    rare = broken.join(lex, "word", "left").unionByName(lex).groupBy("word").agg(F.max("n_clean").alias("n_clean"), F.max("n_all").alias("n_all")).where(f"coalesce(n_clean, 0) < {KNOWN} AND length(word) >= {LEAST_LETTERS}")
    letters = F.length(F.regexp_replace("word", r"[^\p{L}]", ""))
    asked = rare.where(letters * 2 >= F.length("word")).select("word", F.coalesce("n_all", F.lit(0)).alias("n_word"), F.coalesce("n_clean", F.lit(0)).alias("n_clean"), folded("word").alias("q"))
    known = lex.where(f"(n_clean >= {KNOWN} OR n_all >= {2 * KNOWN}) AND length(word) >= {LEAST_LETTERS}").where(F.col("word").rlike(r"^\p{L}[\p{L}'’-]*$")).select(F.col("word").alias("repair"), "n_all")
    left = asked.select("*", F.explode(deletes_of("q")).alias("k"))
    right = known.select("*", F.explode(deletes_of("repair")).alias("k"))
    met = left.join(right, "k").where("word <> repair AND n_all >= %d * n_word" % RATIO).where(F.expr("levenshtein(q, repair, 2) >= 0")).select("word", "repair", "n_all", "n_clean").distinct()
    met = cut(met.repartition(partitions, "word"), "p1-met")
    confusions = confusion_pairs(learned_confusions(met))

    @pandas_udf(DoubleType())
    def distance_of(read: pd.Series, word: pd.Series) -> pd.Series:
        return pd.Series([weighted_distance(a, b, LIMIT, confusions) for a, b in zip(read, word)], dtype=float)

    # a number of partitions that is not coalesced: the distances are few rows, but much work
    return met.repartition(partitions).select("word", "repair", distance_of("word", "repair").alias("cost"), "n_all").where(F.col("cost") < LIMIT)


def neighbour_counts(notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(a, b, n)``: how often word b follows word a in all notes, where one of them is wanted (column ``w``).

    The same words are counted in the same way however many are wanted: up to MOST_WANTED of them are sent to the tasks,
    so that other pairs need not leave them; more are met by joins.
    """
    texts = notes.where("raw_content IS NOT NULL").select("raw_content")
    few = wanted.count() <= MOST_WANTED
    words = notes.sparkSession.sparkContext.broadcast({r.w for r in wanted.collect()} if few else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        for batch in batches:
            tally: Counter = Counter()
            for text in batch.column(0).to_pylist():
                tokens = text.split()
                for t in tokens:
                    if t not in known:
                        known[t] = core(t)
                plain = [known[t] for t in tokens]
                runs = zip(plain, plain[1:])
                tally.update(runs if words.value is None else (p for p in runs if p[0] in words.value or p[1] in words.value))
            if len(known) > 1_000_000:
                known.clear()
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in tally], pa.string()), pa.array([b for _, b in tally], pa.string()), pa.array(list(tally.values()), pa.int64())], names=["a", "b", "n"])

    counts = texts.mapInArrow(run, "a string, b string, n bigint")
    if not few:
        counts = counts.join(wanted.select(F.col("w").alias("a"), F.lit(1).alias("wa")), "a", "left").join(wanted.select(F.col("w").alias("b"), F.lit(1).alias("wb")), "b", "left").where("wa = 1 OR wb = 1")
    return counts.groupBy("a", "b").agg(F.sum("n").alias("n"))


def repairs(notes: DataFrame, lines: DataFrame, lex: DataFrame) -> DataFrame:
    """``(note_id, line_no, idx, word, repair)`` of every misread word of the running text.

    Cost, frequency and the counts of the word before and after pick one of several candidates.
    """
    cands = cut(candidates(lex, lines), "p1-candidates")
    w = Window.partitionBy("note_id").orderBy("line_no", "t.idx")
    words = lines.where("kind = 'text'").select("note_id", "line_no", F.explode("tokens").alias("t")).withColumn("prev", F.lag("t.word").over(w)).withColumn("next", F.lead("t.word").over(w))
    hits = words.select("note_id", "line_no", F.col("t.idx").alias("idx"), F.col("t.word").alias("word"), "prev", "next").join(cands, "word")
    options = cands.groupBy("word").agg(F.count("*").alias("n_options")).where("n_options > 1").select("word")
    many = cut(hits.join(options, "word", "left_semi"), "p1-many")
    single = hits.join(options, "word", "left_anti").select("note_id", "line_no", "idx", "word", "repair")
    wanted = many.select(F.col("repair").alias("w")).distinct()
    around = cut(neighbour_counts(notes, wanted), "p1-pairs")
    second, first = around.select("a", "b", F.col("n").alias("n_prev")), around.select("a", "b", F.col("n").alias("n_next"))
    rated = many.join(second.select(F.col("a").alias("prev"), F.col("b").alias("repair"), "n_prev"), ["prev", "repair"], "left").join(first.select(F.col("a").alias("repair"), F.col("b").alias("next"), "n_next"), ["repair", "next"], "left")
    score = F.log1p(F.coalesce("n_prev", F.lit(0))) + F.log1p(F.coalesce("n_next", F.lit(0))) + 0.5 * F.log("n_all") - 8 * F.col("cost")
    best = rated.groupBy("note_id", "line_no", "idx", "word").agg(F.max_by("repair", F.struct(score.alias("s"), F.col("repair"))).alias("repair"))
    return single.unionByName(best.select("note_id", "line_no", "idx", "word", "repair"))


def broken_words(lines: DataFrame, lex: DataFrame, fixes: DataFrame) -> DataFrame:
    """``(note_id, line_no, idx, line2, head, tail, repair, joined)`` of words divided at a line end; ``joined`` says
    whether the mark there is not part of the word."""
    split = lines.where("kind = 'text'").select("note_id", "line_no", F.explode("tokens").alias("t")).where("t.line2 IS NOT NULL").select("note_id", "line_no", "t.idx", "t.line2", "t.word", "t.head", "t.tail", F.concat("t.head", F.lit("-"), "t.tail").alias("marked"))
    known = lex.where("n_all >= 2").select("word", "n_clean", "n_all")
    split = split.join(known.select("word", F.col("n_all").alias("n_joined")), "word", "left").join(known.select(F.col("word").alias("marked"), F.col("n_all").alias("n_marked")), "marked", "left")
    part = known.where("n_clean >= 3")
    split = split.join(part.select(F.col("word").alias("head"), F.col("n_clean").alias("n_head")), "head", "left").join(part.select(F.col("word").alias("tail"), F.col("n_clean").alias("n_tail")), "tail", "left")
    split = split.join(fixes.select("note_id", "line_no", "idx", "repair"), ["note_id", "line_no", "idx"], "left")
    two_words = F.col("n_head").isNotNull() & F.col("n_tail").isNotNull() & (F.length("head") >= 2) & (F.length("tail") >= 2)
    joined = (
        F.when(F.coalesce("n_marked", F.lit(0)) > F.coalesce("n_joined", F.lit(0)), False).when(F.col("n_joined").isNotNull(), True).when(F.col("repair").isNotNull(), ~F.col("repair").contains("-")).otherwise(~two_words)
    )
    return split.withColumn("joined", joined).select("note_id", "line_no", "idx", "line2", "head", "tail", "repair", "joined", "n_marked")


def scan_noise(notes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lines of scanned notes, their misread words, and their broken words (cut tables)."""
    lines = cut(scanned_lines(notes), "p1-lines")
    lex = cut(lexicon(notes, lines), "p1-lexicon")
    fixes = cut(repairs(notes, lines, lex), "p1-repairs")
    return lines, fixes, cut(broken_words(lines, lex, fixes), "p1-broken")


def noisy_lines(notes: DataFrame) -> DataFrame:
    """``(note_id, line_no, kind)``: what is wrong with which line of the scanned notes.

    Null ids and texts have no rows; repeated rows of an id count once (the earliest); an empty table gives no rows.
    """
    lines, fixes, broken = scan_noise(notes)
    marks = lines.where("kind IN ('header', 'pageno')").select("note_id", "line_no", "kind")
    hyphens = broken.where("joined").select("note_id", "line_no", F.lit("hyphen").alias("kind"))
    whole = fixes.join(broken, ["note_id", "line_no", "idx"], "left_anti").select("note_id", "line_no")
    halves = broken.where("repair IS NOT NULL AND n_marked IS NULL").withColumn("plain", F.regexp_replace("repair", "-", ""))
    one = halves.where(~F.expr("startswith(plain, replace(head, '-', ''))")).select("note_id", "line_no")
    two = halves.where(~F.expr("endswith(plain, replace(tail, '-', ''))")).select("note_id", F.col("line2").alias("line_no"))
    misread = whole.unionByName(one).unionByName(two).select("note_id", "line_no", F.lit("misread").alias("kind"))
    return marks.unionByName(hyphens).unionByName(misread).distinct()


def repaired(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(tbl, id, text)``: scanned notes, and the chunks cut from them, as continuous paragraphs divided by blank lines.

    A chunk is made of the lines that begin within its slice of the note.  Its note is the one of its note_id, or where
    that is no scanned note the one that its own id names.  A chunk without such a note, or without a slice, is repaired
    by itself if its text has page headings, and has no row else.
    """
    held = chunks.where("id IS NOT NULL").select("id", "text", "ingested_at" if "ingested_at" in chunks.columns else F.lit(None).cast("timestamp_ntz").alias("ingested_at"), F.lower(F.trim("note_id")).alias("n1"), F.regexp_extract("id", r"^(.*)_chunk_[0-9]+$", 1).alias("n2"), "start_char", "end_char")
    known = notes.where(F.col("id").isNotNull() & is_scanned()).select("id").distinct()
    held = held.join(known.select(F.col("id").alias("n1"), F.lit(1).alias("k1")), "n1", "left").join(known.select(F.col("id").alias("n2"), F.lit(1).alias("k2")), "n2", "left")
    held = held.withColumn("note", F.when((F.col("start_char") >= 0) & (F.col("end_char") >= 0), F.when(F.col("k1") == 1, F.col("n1")).when(F.col("k2") == 1, F.col("n2"))))
    alone = held.where("note IS NULL").where(is_scanned("text")).select(F.concat(F.lit(_ALONE), "id").alias("id"), F.col("text").alias("raw_content"), "ingested_at")
    lines, fixes, broken = scan_noise(notes.select("id", "raw_content", "ingested_at").unionByName(alone))
    words = lines.where("kind = 'text'").select("note_id", "line_no", "start", "opens", F.posexplode("tokens").alias("k", "t")).select("note_id", "line_no", "start", "k", (F.col("opens") & (F.col("k") == 0)).alias("opens"), "t.idx", "t.raw", "t.word")
    words = words.join(fixes.select("note_id", "line_no", "idx", "repair"), ["note_id", "line_no", "idx"], "left").join(broken.select("note_id", "line_no", "idx", "head", "tail", "joined"), ["note_id", "line_no", "idx"], "left")
    capital = F.expr("CASE WHEN raw RLIKE '^[^\\\\p{L}]*\\\\p{Lu}' THEN concat(upper(substr(repair, 1, 1)), substr(repair, 2)) ELSE repair END")
    tail = F.regexp_extract("raw", r"([.,;:?!…\"'”’)\]]*)$", 1)
    lead = F.when(F.col("word").startswith("("), "").otherwise(F.regexp_extract("raw", r"^([\"'“‘(\[]*)", 1))
    shown = F.when(F.col("repair").isNotNull(), F.concat(lead, capital, tail)).when(F.col("joined") == F.lit(False), F.concat("head", F.lit("-"), "tail", tail)).otherwise(F.col("raw"))
    words = words.select("note_id", "line_no", "start", "k", F.concat(F.when(F.col("opens"), "\n\n").otherwise(" "), shown).alias("w"))
    by_line = words.groupBy("note_id", "line_no", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "w"))), lambda x: x["w"]), "").alias("w"))

    def text(df: DataFrame, *keys: str) -> DataFrame:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "w"))), lambda x: x["w"]), "")
        return df.groupBy(*keys).agg(F.trim(F.regexp_replace(joined, r"^\s+", "")).alias("text"))

    cuts = held.where("note IS NOT NULL").select(F.col("id").alias("chunk_id"), F.col("note").alias("note_id"), "start_char", "end_char").distinct()
    single = F.col("note_id").startswith(_ALONE)
    own = text(by_line, "note_id").select(F.when(single, "chunks").otherwise("notes").alias("tbl"), F.when(single, F.substr("note_id", F.lit(len(_ALONE) + 1))).otherwise(F.col("note_id")).alias("id"), "text")
    parts = text(by_line.join(cuts, "note_id").where("start >= start_char AND start < end_char"), "chunk_id").select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("id"), "text")
    return own.unionByName(parts)
