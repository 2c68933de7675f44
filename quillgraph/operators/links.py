"""Links between notes in five stages: explicit links, stored edges between notes, shared entities, relations of their
entities, similar texts.  Each pair of notes is linked once, by the first stage that has it."""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import clean_stem, lexical_tokens, stripped, wikilinks
from quillgraph.operators.pairs import pairs_within
from quillgraph.operators.references import key
from quillgraph.session import BROADCAST_KEYS, cut, lookup

#: Names of fewer characters are not looked for in texts; weight of a link by a shared entity, and of a relation without weight.
LEAST_NAME, SHARED_WEIGHT, PLAIN_WEIGHT = 4, 0.85, 0.8
#: Least cosine similarity of two notes that are linked by their texts.
SIMILAR = 0.70
#: Vectors of a block (more where there are many) and codes of a block on average; cells of a product that a task holds; two
#: blocks are multiplied as matrices at a code that more than this share of the pairs of their vectors have.
LEAST_ROWS, MOST_ROWS, MOST_CODES, MOST_CELLS, DENSE = 4096, 16384, 1 << 22, 1 << 24, 0.004
#: Names of up to so many words are found in texts by equality, longer ones meet by a part of so many words.
GRAM = 3
#: A letter of a word; the mark that is put around the words of a text, so that whole words are found by a plain search.
_WORD, _MARK = r"[\p{L}\p{N}_]", "\x01"


def aliases(notes: DataFrame) -> DataFrame:
    """``(alias, note)``: all keys under which a note is linked; of several notes the one with the largest id."""
    name = F.regexp_extract("source_file", r"([^/]*)$", 1)
    each = F.array(F.lower("id"), clean_stem("id"), F.lower("title"), clean_stem("title"), F.lower(name), F.lower(F.regexp_replace(name, r"\.[^.]*$", "")), clean_stem(name))
    return notes.select(F.col("id").alias("note"), F.explode(F.array_distinct(F.array_compact(each))).alias("alias")).where("alias <> ''").groupBy("alias").agg(F.max("note").alias("note"))


def explicit_links(notes: DataFrame) -> DataFrame:
    """``(a, b)``: notes and the notes that their ``[[targets]]`` name, exactly or in cleaned form."""
    out = notes.select(F.col("id").alias("a"), F.explode(wikilinks("raw_content")).alias("target")).select("a", F.lower("target").alias("exact"), clean_stem("target").alias("clean")).distinct()
    known = aliases(notes)
    found = out.join(known.select(F.col("alias").alias("exact"), F.col("note").alias("n1")), "exact", "left").join(known.select(F.col("alias").alias("clean"), F.col("note").alias("n2")), "clean", "left")
    return found.select("a", F.coalesce("n1", "n2").alias("b")).where("b IS NOT NULL AND a <> b").distinct()


def stored_links(view: DataFrame, notes: DataFrame) -> DataFrame:
    """``(a, b, weight)``, ``a < b``: stored edges whose two ends are notes, with the largest weight."""
    ids = notes.select(key("id").alias("n")).where("n IS NOT NULL").distinct()
    met = view.where("source <> target").join(ids.withColumnRenamed("n", "source"), "source", "left_semi").join(ids.withColumnRenamed("n", "target"), "target", "left_semi")
    return met.groupBy(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).agg(F.max("weight").alias("weight"))


def entity_notes(prov: DataFrame, chunks: DataFrame, notes: DataFrame) -> DataFrame:
    """``(entity, note)``: notes from whose chunks an entity comes; a chunk that is not there still names its note."""
    of = chunks.select(key("id").alias("chunk"), key("note_id").alias("note")).dropDuplicates(["chunk"])
    ids = notes.select(key("id").alias("note")).distinct()
    met = prov.join(of, "chunk", "left").select(key("id").alias("entity"), F.coalesce("note", F.regexp_replace("chunk", r"_chunk_[^_]*$", "")).alias("note"))
    return met.join(ids, "note", "left_semi").select("entity", "note").distinct()


def _marked(column: str | Column) -> Column:
    """A text in lower case with a mark on both sides of every word."""
    return F.regexp_replace(F.lower(column), rf"{_WORD}+", f"{_MARK}$0{_MARK}")


def _phrases(column: str | Column, words: int) -> Column:
    """All runs of so many words of a text in lower case, with what stands between the words; runs may overlap."""
    return F.regexp_extract_all(column, F.lit(rf"(?<!{_WORD})(?=(" + rf"[^\p{{L}}\p{{N}}_]++".join([rf"{_WORD}++"] * words) + "))"), 1)


def mentions(nodes: DataFrame, notes: DataFrame) -> DataFrame:
    """``(entity, note)``: notes in whose title or content an entity's name stands as whole words, in any case.

    Names under four characters and ``untitled...`` are not looked for.  Names and notes meet by an equality join: on the
    whole name, if it is a run of up to GRAM words, else on its rarest run of GRAM words, and then the whole name is
    looked up in the text; a name without words meets every text.  Equal names are looked for once.  Null names and
    texts match nothing.
    """
    named = nodes.select(key("id").alias("entity"), stripped("name").alias("name")).where(F.length("name") >= LEAST_NAME).where(~F.lower("name").startswith("untitled")).select("entity", F.lower("name").alias("name")).distinct()
    k = F.size(F.regexp_extract_all("name", F.lit(rf"({_WORD}+)"), 1))
    plain = F.col("name").rlike(rf"^{_WORD}.*{_WORD}$|^{_WORD}$") & (k <= GRAM)
    names = cut(named.select("name").distinct().withColumn("k", k).withColumn("plain", F.coalesce(plain, F.lit(False))), "names")
    texts = notes.select(key("id").alias("note"), F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("raw_content", F.lit("")))).alias("text"))
    asked = names.where("plain").select("name", F.col("name").alias("phrase"))
    longer = reduce(DataFrame.unionByName, [names.where(~F.col("plain") & (F.least("k", F.lit(GRAM)) == n)).select("name", F.explode(_phrases("name", n)).alias("phrase")) for n in range(1, GRAM + 1)]).distinct()
    sought = lookup(asked.select("phrase").union(longer.select("phrase")).distinct(), label="phrases")
    grams = F.array_distinct(F.concat(*(_phrases("text", n) for n in range(1, GRAM + 1))))
    held = cut(texts.select("note", F.explode(grams).alias("phrase")).join(sought, "phrase", "left_semi"), "note-phrases")
    counts = held.groupBy("phrase").agg(F.count("*").alias("n"))
    # a name with a run of words that no note has is in no note
    rare = longer.join(counts, "phrase", "left").groupBy("name").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "phrase")).alias("r")).where("r.n > 0").select("name", "r.phrase")
    marked = texts.select("note", _marked("text").alias("text"))
    maybe = rare.join(held, "phrase").select("name", _marked("name").alias("sought"), "note")
    wordless = lookup(names.where("k = 0").select("name"), label="wordless")
    found = [
        asked.join(held, "phrase").select("name", "note"),
        maybe.join(marked, "note").where(F.contains("text", "sought")).select("name", "note"),
        marked.join(wordless, F.contains("text", "name")).select("name", "note"),
    ]
    return named.join(reduce(DataFrame.unionByName, found), "name").select("entity", "note").distinct()


def shared_entity_links(held: DataFrame) -> DataFrame:
    """``(a, b, n_shared)``, ``a < b``: all pairs of notes with entities in common; hot entities are joined in blocks."""
    return pairs_within(held, ["entity"], "note").groupBy("a", "b").agg(F.count("*").alias("n_shared"))


def shared_entity_classes(held: DataFrame) -> DataFrame:
    """``(note, class, n_entities, n_notes)``: notes with the same entities are one class, named by its smallest note.

    The links by shared entities in a form that grows with the rows of ``held``, not with the pairs: all notes of a class
    have the same links, and two classes are linked if ``held`` has an entity for both.
    """
    h = lambda seed: F.sum(F.xxhash64("entity", F.lit(seed)).cast("decimal(38,0)"))
    sets = held.groupBy("note").agg(F.count("*").alias("n_entities"), h(1).alias("h1"), h(2).alias("h2"))
    same = sets.groupBy("n_entities", "h1", "h2").agg(F.min("note").alias("class"), F.count("*").alias("n_notes"))
    return sets.join(same, ["n_entities", "h1", "h2"]).select("note", "class", "n_entities", "n_notes")


def relation_links(view: DataFrame, held: DataFrame) -> DataFrame:
    """``(a, b, weight)``: notes of an edge's source and of its target, with the largest weight of such an edge.

    Edges without a stated weight count 0.8.  Parallel edges are one before they meet the notes.
    """
    weight = F.when(F.col("weighted"), F.col("weight")).otherwise(PLAIN_WEIGHT)
    ends = view.where("source <> target").groupBy(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.max(weight).alias("weight"))
    a, b = held.select(F.col("entity").alias("source"), F.col("note").alias("x")), held.select(F.col("entity").alias("target"), F.col("note").alias("y"))
    met = ends.join(a, "source").join(b, "target").where("x <> y")
    return met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.round(F.max("weight"), 2).alias("weight"))


def term_vectors(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, term, df, w)``: unit vectors of terms weighed by frequency and rarity; terms that all texts have weigh nothing."""
    found = texts.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(lexical_tokens(F.coalesce(text_col, F.lit("")))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    n = texts.where(F.col(id_col).isNotNull()).agg(F.countDistinct(id_col).alias("n"))
    rated = found.join(df, "term").crossJoin(F.broadcast(n)).select("id", "term", "df", (F.col("tf") * F.log(F.col("n") / F.col("df"))).alias("w")).where("w > 0")  # one row
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return rated.select("id", "term", "df", (F.col("w") / norm).alias("w"))


def _counted(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, terms, tf)``: the different terms of all texts of an id and how often each occurs.  Only ids that occur more
    than once are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            words = lists.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            size = max(1, len(words.dictionary))
            both, tf = np.unique(row * size + words.indices.to_numpy(), return_counts=True)
            starts = pa.array(np.searchsorted(both, np.arange(len(lists) + 1) * size).astype(np.int32))
            terms = words.dictionary.take(pa.array(both % size))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(starts, terms), pa.ListArray.from_arrays(starts, pa.array(tf.astype(np.int32)))], names=["id", "terms", "tf"])

    rows = texts.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), lexical_tokens(F.coalesce(text_col, F.lit(""))).alias("tokens"))
    again = lookup(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), label="repeated-ids")
    merged = rows.join(again, "id", "left_semi").groupBy("id").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    return rows.join(again, "id", "left_anti").unionByName(merged).mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, terms array<string>, tf array<int>")


def similar_texts(texts: DataFrame, id_col: str, text_col: str, least: float = SIMILAR, others: DataFrame | None = None) -> DataFrame:
    """:func:`similar_pairs` of the texts' :func:`term_vectors`, without a row for each text and term.

    With ``others``, see :func:`linked_counts`.
    """
    counted = cut(_counted(texts, id_col, text_col), "note-terms")
    df = cut(counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").cast("double").alias("df")), "note-terms-df")
    if df.count() > BROADCAST_KEYS:
        packed = _packed(cut(term_vectors(texts, id_col, text_col), "note-vectors"))
        every = counted.select("id").join(packed, "id", "left").select("id", *(F.coalesce(c, F.array().cast(packed.schema[c].dataType)).alias(c) for c in ("code", "value", "scale")), F.lit(1.0).alias("norm"))
        return _met_in_blocks(every, least, others)
    known, n = df.toPandas(), counted.count()
    sent = counted.sparkSession.sparkContext.broadcast((known["term"].tolist(), np.log(n / known["df"].to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = sent.value
        terms = pa.array(terms, pa.string())
        for batch in batches:
            lists, tf = batch.column(1), batch.column(2).flatten().to_numpy()
            code = pc.index_in(lists.flatten(), value_set=terms).to_numpy()
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            w = tf * idf[code]
            norm, kept = np.sqrt(np.bincount(row, w * w, len(lists))), w > 0
            starts = pa.array(np.searchsorted(row[kept], np.arange(len(lists) + 1)).astype(np.int32))
            made = [pa.ListArray.from_arrays(starts, pa.array(x[kept])) for x in (code.astype(np.int64), tf.astype(np.float64), idf[code])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made, pa.array(norm)], names=["id", "code", "value", "scale", "norm"])

    kind = counted.schema["id"].dataType.simpleString()
    return _met_in_blocks(counted.mapInArrow(run, f"id {kind}, code array<bigint>, value array<double>, scale array<double>, norm double"), least, others)


def linked_counts(texts: DataFrame, id_col: str, text_col: str, others: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``(note, n)``: to how many texts each one is linked, by similarity or by a pair ``(a, b)`` of ``others``; one row for
    each note that has a link.  Similar pairs are counted where they are found and never written or shuffled: the other pairs
    come there, and a pair that both have counts once.  The ends of ``others`` are ids of ``texts``.
    """
    return similar_texts(texts, id_col, text_col, least, others).groupBy("note").agg(F.sum("n").alias("n"))


def _packed(vectors: DataFrame) -> DataFrame:
    """Rows of :func:`_met_in_blocks` of :func:`term_vectors`; terms are told apart by a hash of 64 bits."""
    packed = vectors.groupBy("id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("code"), "w")).alias("x"))
    return packed.select("id", "x.code", F.col("x.w").alias("value"), F.transform("x", lambda _: F.lit(1.0)).alias("scale"), F.lit(1.0).alias("norm"))


def similar_pairs(vectors: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``(a, b, similarity)``, ``a < b``: all pairs of :func:`term_vectors` whose cosine is ``least`` or more, exactly.

    Vectors are put into blocks, and each two blocks are multiplied by one task.  Terms are told apart by a hash of 64 bits.
    """
    return _met_in_blocks(_packed(vectors), least)


def _met_in_blocks(rows: DataFrame, least: float, others: DataFrame | None = None) -> DataFrame:
    """``(a, b, similarity)``, or ``(note, n)`` of each two blocks if there are ``others``, of rows ``(id, code, value, scale, norm)``: a vector has value * scale / norm at each code.

    Between two blocks, the codes that many of their vectors have are multiplied as matrices, the others one by one.
    """
    n, size = rows.select(F.count("*"), F.sum(F.size("code"))).first()
    n_blocks = max(1, math.ceil(n / min(MOST_ROWS, max(LEAST_ROWS, 2 ** math.ceil(math.log2(max(1, n) / 16))))), math.ceil((size or 0) / MOST_CODES))
    kind = rows.schema["id"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        column = lambda name: table.column(name).combine_chunks()
        lists = column("code")
        codes, first, at = np.unique(lists.flatten().to_numpy(), return_index=True, return_inverse=True)
        scale = column("scale").flatten().to_numpy()[first]
        made = (lists.value_lengths().to_numpy(), codes, scale, at.astype(np.int32), column("value").flatten().to_numpy(), column("norm").to_numpy())
        return pa.table({"p": pa.array([table.column("p")[0].as_py()], pa.int32()), "ids": pa.array([column("id").to_pylist()], pa.list_(column("id").type)), "data": pa.array([zlib.compress(pickle.dumps(made), 1)], pa.binary())})

    def unpacked(data: bytes) -> tuple:
        lengths, codes, scale, at, value, norm = pickle.loads(zlib.decompress(data))
        row = np.repeat(np.arange(len(lengths)), lengths)
        order = np.argsort(at, kind="stable")
        starts = np.append(0, np.cumsum(np.bincount(at, minlength=len(codes))))
        return codes, starts, row[order], (value * scale[at] / norm[row])[order], len(lengths)

    def products(x: tuple, y: tuple, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
        frequent = (x[1][i + 1] - x[1][i]) * (y[1][j + 1] - y[1][j]) > DENSE * x[4] * y[4]
        dense = []
        for z, k in ((x, i[frequent]), (y, j[frequent])):
            m = np.zeros((z[4], len(k)))
            for c, t in enumerate(k):
                m[z[2][z[1][t] : z[1][t + 1]], c] = z[3][z[1][t] : z[1][t + 1]]
            dense.append(m)
        i, j = i[~frequent], j[~frequent]
        step = max(1, MOST_CELLS // max(1, y[4]))
        for at in range(0, x[4], step):
            s = dense[0][at : at + step] @ dense[1].T
            for t, u in zip(i, j):
                r = x[2][x[1][t] : x[1][t + 1]]
                lo, hi = np.searchsorted(r, (at, at + step)) + x[1][t]
                if hi > lo:
                    s[np.ix_(x[2][lo:hi] - at, y[2][y[1][u] : y[1][u + 1]])] += np.outer(x[3][lo:hi], y[3][y[1][u] : y[1][u + 1]])
            a, b = np.nonzero(s >= least)
            if same:
                upper = a + at < b
                a, b = a[upper], b[upper]
            yield a + at, b, s[a, b]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            for k in range(batch.num_rows):
                p, q, side = (batch.column(c)[k].as_py() for c in range(3))
                now = (pa.concat_arrays([batch.column(3)[k].values]), unpacked(batch.column(4)[k].as_py()))
                if p != q and side == 0:
                    left = now
                    continue
                one = now if p == q else left
                for a, b, s in products(one[1], now[1], p == q):
                    x, y = one[0].take(pa.array(a)), now[0].take(pa.array(b))
                    swap = pc.greater(x, y)
                    yield pa.RecordBatch.from_arrays([pc.if_else(swap, y, x), pc.if_else(swap, x, y), pa.array(s)], names=["a", "b", "similarity"])

    def counted(x: pa.Array, y: pa.Array, bits: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        step = max(1, MOST_CELLS // max(1, len(y)))
        down, across = np.zeros(len(y), np.int64), np.zeros(len(x), np.int64)
        for at in range(0, len(x), step):
            m = np.unpackbits(bits[at : at + step], axis=1, count=len(y))
            down += m.sum(axis=0, dtype=np.int64)
            across[at : at + step] = m.sum(axis=1, dtype=np.int64)
        for ids, n in ([(x, across + down)] if same else [(x, across), (y, down)]):
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(n[some])], names=["note", "n"])

    def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bit for each pair of two blocks' texts: the similar ones, then the others as they come."""
        left = state = None
        for batch in batches:
            side = np.asarray(batch.column(2))
            k = 0
            while k < batch.num_rows:
                p, q = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                if side[k] < 2:
                    now = (pa.concat_arrays([batch.column(3)[k].values]), unpacked(batch.column(4)[k].as_py()))
                    if side[k] == 0 and state:
                        yield from counted(*state)
                        state = None
                    if p != q and side[k] == 0:
                        left = now
                    else:
                        one = now if p == q else left
                        bits = np.zeros((len(one[0]), (len(now[0]) + 7) // 8), np.uint8)
                        for a, b, _ in products(one[1], now[1], p == q):
                            np.bitwise_or.at(bits, (a, b >> 3), (128 >> (b & 7)).astype(np.uint8))
                        state = (one[0], now[0], bits, p == q)
                    k += 1
                    continue
                ends = np.flatnonzero((side[k:] < 2) | (np.asarray(batch.column(0))[k:] != p) | (np.asarray(batch.column(1))[k:] != q))
                n = int(ends[0]) if len(ends) else batch.num_rows - k
                a, b = (pc.index_in(batch.column(5 + c).slice(k, n), value_set=state[c]).to_numpy(zero_copy_only=False) for c in range(2))
                if np.isnan(a.astype(float)).any() or np.isnan(b.astype(float)).any():
                    raise ValueError("a link has an end that is no text")
                if p == q:
                    a, b = np.minimum(a, b), np.maximum(a, b)
                np.bitwise_or.at(state[2], (a.astype(np.int64), b.astype(np.int64) >> 3), (128 >> (b.astype(np.int64) & 7)).astype(np.uint8))
                k += n
        if state:
            yield from counted(*state)

    blocks = cut(rows.withColumn("p", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).groupBy("p").applyInArrow(pack, f"p int, ids array<{kind}>, data binary"), "note-blocks")
    left = blocks.select("p", F.explode(F.sequence("p", F.lit(n_blocks - 1))).alias("q"), F.lit(0).alias("side"), "ids", "data")
    right = blocks.where("p > 0").select(F.explode(F.sequence(F.lit(0), F.col("p") - 1)).alias("q"), F.lit(1).alias("side"), F.col("p").alias("_p"), "ids", "data").select(F.col("q").alias("p"), F.col("_p").alias("q"), "side", "ids", "data")
    both = left.unionByName(right)
    if others is not None:
        place = lambda c: F.pmod(F.xxhash64(c), F.lit(n_blocks)).cast("int")
        turned = others.where("a <> b").withColumn("x", F.struct(place("a").alias("p"), F.col("a").alias("id"))).withColumn("y", F.struct(place("b").alias("p"), F.col("b").alias("id")))
        placed = turned.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).select(F.col("x.p").alias("p"), F.col("y.p").alias("q"), F.lit(2).alias("side"), F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        met = both.unionByName(placed, allowMissingColumns=True).repartition(n_blocks * (n_blocks + 1) // 2, "p", "q").sortWithinPartitions("p", "q", "side")
        return met.select("p", "q", "side", "ids", "data", "a", "b").mapInArrow(united, f"note {kind}, n bigint")
    met = both.repartition(n_blocks * (n_blocks + 1) // 2, "p", "q").sortWithinPartitions("p", "q", "side")
    return met.mapInArrow(run, f"a {kind}, b {kind}, similarity double")


def note_graph(explicit: DataFrame, stored: DataFrame, shared: DataFrame, related: DataFrame, similar: DataFrame) -> DataFrame:
    """``(a, b, stage, weight)``: every linked pair once; of several stages the first counts, of its weights the largest."""
    parts = [
        explicit.select(key("a").alias("a"), key("b").alias("b"), F.lit(1).alias("stage"), F.lit(1.0).alias("weight")),
        stored.select("a", "b", F.lit(2).alias("stage"), "weight"),
        shared.select("a", "b", F.lit(3).alias("stage"), F.lit(SHARED_WEIGHT).alias("weight")),
        related.select("a", "b", F.lit(4).alias("stage"), "weight"),
        similar.select("a", "b", F.lit(5).alias("stage"), F.round("similarity", 3).alias("weight")),
    ]
    every = reduce(DataFrame.unionByName, parts).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "stage", "weight").where("a <> b")
    first = every.groupBy("a", "b").agg(F.min(F.struct("stage", (-F.col("weight")).alias("less"))).alias("x"))
    return first.select("a", "b", F.col("x.stage").cast("bigint").alias("stage"), (-F.col("x.less")).alias("weight"))


def link_pairs(explicit: DataFrame, stored: DataFrame, shared: DataFrame, related: DataFrame) -> DataFrame:
    """``(a, b)``: linked pairs of the first four stages, some of them several times."""
    parts = [explicit.select(key("a").alias("a"), key("b").alias("b")), *(x.select("a", "b") for x in (stored, shared, related))]
    return reduce(DataFrame.unionByName, parts).where("a <> b")


def with_degrees(notes: DataFrame, counts: DataFrame) -> DataFrame:
    """``(note, degree)`` of all notes by ``(note, n)`` of those with links, 0 for those without a link."""
    return notes.select(key("id").alias("note")).distinct().join(counts, "note", "left").select("note", F.coalesce("n", F.lit(0)).alias("degree"))


def note_degrees(notes: DataFrame, links: DataFrame) -> DataFrame:
    """``(note, degree)`` of all notes, 0 for those without a link."""
    return with_degrees(notes, links.select(F.explode(F.array("a", "b")).alias("note")).groupBy("note").agg(F.count("*").alias("n")))


def linked_notes(notes: DataFrame, degree: DataFrame) -> DataFrame:
    """``(id, title, degree)``: the notes that an editor lists, most linked first by their degree."""
    return notes.select("id", "title", key("id").alias("note")).join(degree, "note").select("id", "title", "degree")


def graph_stats(n_notes: DataFrame, counts: DataFrame) -> DataFrame:
    """``(notes, links, density, avg_degree)`` of an undirected graph by ``(note, n)`` of the notes with links, zeroes where
    it is empty."""
    n_links = counts.agg((F.coalesce(F.sum("n"), F.lit(0)) / 2).cast("bigint").alias("links"))
    both = n_notes.agg(F.count("*").alias("notes")).crossJoin(n_links)  # one row each
    n, m = F.col("notes"), F.col("links")
    return both.select("notes", "links", F.round(F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(0.0), 6).alias("density"), F.round(F.when(n > 0, 2 * m / n).otherwise(0.0), 4).alias("avg_degree"))
