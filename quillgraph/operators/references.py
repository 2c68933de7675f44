"""References to records that do not exist (problem 3).

Every row of a table contributes signed deltas: a row that comes counts up, a row that goes (removed, retracted, moved to
another key, or written anew) counts the same down again.  Deltas add up to two states: existence per key and arrival, and
references per record, key and arrival.  Keys with positive references and no existence are orphans, whatever the order in
which the changes came.  A state is kept up by adding the deltas of a change set, without reading old tables again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import cut

#: A key is hot if it has more than this share of all references, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 0.001
#: The columns that name a delta of existence, and one of a reference; both have a signed count ``n`` beside them.
RECORD = ["tbl", "key", "note", "at", "gone"]
REFERENCE = ["tbl", "field", "record_id", "target_tbl", "ref_key", "at"]


def key(column: str | Column) -> Column:
    """A key in the form in which keys are compared: trimmed and in lower case; null where nothing is left."""
    plain = F.lower(F.regexp_replace(column if isinstance(column, Column) else F.col(column), r"(?U)^\s+|\s+$", ""))
    return F.when(plain != "", plain)


def listed_keys(column: str | Column) -> Column:
    """The different keys of a list in a string: JSON, the same with single quotes, or bare and divided by commas."""
    bare = F.regexp_replace(column if isinstance(column, Column) else F.col(column), r"[\[\]\"']", "")
    return F.array_distinct(F.filter(F.transform(F.split(bare, r"[,;]"), key), lambda x: x.isNotNull() & (x != "null") & (x != "none")))


def record_deltas(notes: DataFrame, chunks: DataFrame, nodes: DataFrame, sign: int = 1) -> DataFrame:
    """:data:`RECORD` and ``n``: each row's existence under its key, with the note that a chunk belongs to."""

    def records(df: DataFrame, tbl: str, note: Column, gone: Column) -> DataFrame:
        return df.select(F.lit(tbl).alias("tbl"), key("id").alias("key"), note.cast("string").alias("note"), F.col("ingested_at").alias("at"), gone.alias("gone"), F.lit(sign).cast("bigint").alias("n")).where("key IS NOT NULL")

    none, no = F.lit(None), F.lit(False)
    return reduce(DataFrame.unionByName, [records(notes, "notes", none, F.col("deleted_at").isNotNull()), records(chunks, "chunks", key("note_id"), no), records(nodes, "nodes", none, no)])


def reference_deltas(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, sign: int = 1) -> DataFrame:
    """:data:`REFERENCE` and ``n``: each row's references, each once; a row without any has one with a null key, as its
    arrival counts for its record."""

    def out(df: DataFrame, tbl: str, target: str, refs: Column) -> DataFrame:
        held = df.where("id IS NOT NULL").select(F.col("id").alias("record_id"), F.col("ingested_at").alias("at"), F.explode(refs).alias("r"))
        return held.select(F.lit(tbl).alias("tbl"), F.col("r.field").alias("field"), "record_id", F.lit(target).alias("target_tbl"), F.col("r.key").alias("ref_key"), "at", F.lit(sign).cast("bigint").alias("n"))

    one = lambda field, k: F.struct(F.lit(field).alias("field"), k.alias("key"))
    listed = F.coalesce(listed_keys("provenance"), F.array().cast("array<string>"))
    return reduce(
        DataFrame.unionByName,
        [
            out(chunks, "chunks", "notes", F.array(one("note_id", key("note_id")))),
            out(nodes, "nodes", "chunks", F.transform(F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit(None).cast("string"))), lambda k: one("provenance", k))),
            out(edges, "edges", "nodes", F.array(one("source", key("source")), one("target", key("target")))),
        ],
    )


def added_up(deltas: DataFrame) -> DataFrame:
    """A state: equal deltas as one with their sum; what has come and gone leaves nothing.

    Deltas of a record lie together, so what is later asked per record needs no further shuffle.
    """
    columns = [c for c in deltas.columns if c != "n"]
    by = ["tbl", "record_id"] if "record_id" in columns else ["tbl", "key"]
    return deltas.repartition(*by).groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")


def changed(state: DataFrame, change: DataFrame) -> DataFrame:
    """A state after further deltas."""
    return added_up(state.unionByName(change))


def live_references(state: DataFrame) -> DataFrame:
    """``(tbl, field, record_id, target_tbl, ref_key, seen)``: each reference of each record once.

    ``seen`` is the first arrival of any row of the record that is still there.
    """
    rows = state.where("n > 0").withColumn("seen", F.min("at").over(Window.partitionBy("tbl", "record_id")))
    return rows.where("ref_key IS NOT NULL").groupBy("tbl", "record_id", "field", "target_tbl", "ref_key").agg(F.min("seen").alias("seen")).select("tbl", "field", "record_id", "target_tbl", "ref_key", "seen")


def key_states(records: DataFrame, refs: DataFrame) -> DataFrame:
    """``(tbl, key, exist, gone, refs, at)`` of all keys that are referred to; ``at`` is the first arrival of the key's record."""
    own = records.select("tbl", "key", F.col("n").alias("exist"), F.when(F.col("gone"), F.col("n")).otherwise(0).alias("gone"), F.lit(0).cast("bigint").alias("refs"), F.when(F.col("n") > 0, F.col("at")).alias("at"))
    asked = refs.groupBy("target_tbl", "ref_key").agg(F.count("*").alias("refs")).select(F.col("target_tbl").alias("tbl"), F.col("ref_key").alias("key"), F.lit(0).cast("bigint").alias("exist"), F.lit(0).cast("bigint").alias("gone"), "refs", F.lit(None).cast(records.schema["at"].dataType).alias("at"))
    sums = own.unionByName(asked).groupBy("tbl", "key").agg(F.sum("exist").alias("exist"), F.sum("gone").alias("gone"), F.sum("refs").alias("refs"), F.min("at").alias("at"))
    return sums.where("refs > 0")


def orphans_of(records: DataFrame, references: DataFrame) -> DataFrame:
    """``(tbl, field, record_id, ref_id, kind, period)`` of the two states of :func:`record_deltas` and :func:`reference_deltas`.

    ``missing``: positive references and no existence; ``deleted``: the note, or the chunk's note, is removed; ``late``: the
    record that is referred to came after the referring one.
    """
    refs = cut(live_references(references), "p3-refs")
    records = cut(records, "p3-records")
    # a chunk counts as deleted if its note is
    gone_notes = records.where("tbl = 'notes' AND gone AND n > 0").select(F.col("key").alias("note")).distinct()
    gone_chunks = records.where("tbl = 'chunks' AND n > 0").join(gone_notes, "note", "left_semi").select("tbl", "key", F.lit(1).alias("by_note")).distinct()
    states = cut(
        key_states(records, refs).join(gone_chunks, ["tbl", "key"], "left").select(
            F.col("tbl").alias("target_tbl"), F.col("key").alias("ref_key"), "refs", F.col("at").alias("target_at"),
            F.when(F.col("exist") <= 0, "missing").when((F.col("gone") > 0) | F.col("by_note").isNotNull(), "deleted").alias("state"),
        ),
        "p3-states",
    )
    total = states.agg(F.sum("refs")).first()[0] or 0
    on = ["target_tbl", "ref_key"]
    hot = F.broadcast(states.where(F.col("refs") > F.lit(HOT_SHARE * total)))
    cold = states.where(F.col("refs") <= F.lit(HOT_SHARE * total))
    # each reference meets its key once: with the few hot keys without a shuffle, with all others by a shuffle on the key
    met = refs.join(hot, on).unionByName(refs.join(hot.select(*on), on, "left_anti").join(cold, on))
    kind = F.coalesce(F.col("state"), F.when(F.col("target_at") > F.col("seen"), "late"))
    return met.withColumn("kind", kind).where("kind IS NOT NULL").select("tbl", "field", "record_id", F.col("ref_key").alias("ref_id"), "kind", F.date_format("seen", "yyyy-MM").alias("period"))


def orphans(notes: DataFrame, chunks: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(tbl, field, record_id, ref_id, kind, period)``: references to missing, deleted or later records.

    Null and blank references and null ids do not count; a reference repeated in a list, and repeated rows of a record,
    count once; the record's and the target's arrival are those of their earliest rows.  Empty tables give no references
    (all references to an empty table are missing).  Only the named columns are read.  ``period`` is null where no row of
    the record has an arrival.
    """
    return orphans_of(added_up(record_deltas(notes, chunks, nodes)), added_up(reference_deltas(chunks, nodes, edges)))


def orphan_report(found: DataFrame) -> DataFrame:
    """``(tbl, field, period, kind, n_refs, n_keys)``: broken references per table and month."""
    return found.groupBy("tbl", "field", "period", "kind").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_id").alias("n_keys"))
