"""Entities and relations found in chunks by markup and capital letters, and in answers of a language model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions.text import ascii_words, normal_name, stripped
from quillgraph.session import cut

# Capitalised words that are no names.
NO_NAMES = ["the", "this", "that", "there", "with", "from", "when"]
# The forms of names in texts, runs of capitalised words and marked spans.
_CAPS = r"(?<![A-Za-z0-9_])[A-Z][a-z0-9]+(?:\s+[A-Z][a-z0-9]+)*(?![A-Za-z0-9_])"
_MARKED = r"\*\*([^*]+)\*\*|`([^`]+)`"


def chunk_entities(chunks: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(chunk_id, ord, name, type, confidence)``: bold and code spans first, then runs of capitalised words.

    Of equal names (in any case) the first place counts; a later span overwrites an earlier one's spelling and type.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = chunks.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("chunk_id"), F.regexp_extract_all(text, F.lit(_MARKED), 0).alias("marked"), F.regexp_extract_all(ascii_words(text), F.lit(_CAPS), 0).alias("caps"))
    marked = rows.select("chunk_id", F.posexplode("marked").alias("pos", "m")).select("chunk_id", F.lit(1).alias("pass"), "pos", stripped(F.regexp_replace("m", r"^\*\*|\*\*$|^`|`$", "")).alias("name"), F.when(F.col("m").startswith("`"), "TECHNOLOGY").otherwise("CONCEPT").alias("type")).where("length(name) BETWEEN 3 AND 49")
    two = F.col("name").rlike(r"^\S+\s+\S+$") & ~F.col("name").rlike(r"[0-9]")
    caps = rows.select("chunk_id", F.posexplode("caps").alias("pos", "name")).where(F.length("name") > 2).where(~F.lower("name").isin(NO_NAMES)).select("chunk_id", F.lit(2).alias("pass"), "pos", "name", F.when(two, "PERSON").otherwise("CONCEPT").alias("type"))
    both = marked.unionByName(caps).withColumn("k", F.lower("name"))
    first = F.min(F.struct("pass", "pos"))
    shown = F.max_by(F.struct("name", "type", "pass"), F.struct(-F.col("pass"), F.when(F.col("pass") == 1, F.col("pos")).otherwise(-F.col("pos"))))
    found = both.groupBy("chunk_id", "k").agg(first.alias("at"), shown.alias("x"))
    order = F.row_number().over(Window.partitionBy("chunk_id").orderBy("at"))
    return found.select("chunk_id", order.cast("bigint").alias("ord"), "x.name", "x.type", F.when(F.col("x.pass") == 1, 0.8).otherwise(0.75).alias("confidence"))


def chunk_relations(entities: DataFrame) -> DataFrame:
    """``(chunk_id, ord, subject, object)``: each entity of a chunk and the next one."""
    w = Window.partitionBy("chunk_id").orderBy("ord")
    return entities.withColumn("object", F.lead("name").over(w)).where("object IS NOT NULL").select("chunk_id", "ord", F.col("name").alias("subject"), "object")


def merged_entities(entities: DataFrame) -> DataFrame:
    """``(key, name, type, n_chunks, n_mentions, confidence)`` per normalised name; spelling and type are those of the
    first mention by chunk and place."""
    keyed = entities.withColumn("key", normal_name("name")).where("key <> ''")
    return keyed.groupBy("key").agg(F.min_by("name", F.struct("chunk_id", "ord")).alias("name"), F.min_by("type", F.struct("chunk_id", "ord")).alias("type"), F.countDistinct("chunk_id").alias("n_chunks"), F.count("*").alias("n_mentions"), F.max("confidence").alias("confidence"))


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """``(key, name, type, description, degree, n)`` per normalised name: name and type are those of the first id, the
    description is the longest (of equally long ones that of the first id), the degree the highest."""
    keyed = nodes.withColumn("key", normal_name("name")).where("key <> ''")
    size = F.when(F.col("description").isNotNull(), F.length("description"))
    longest = F.min_by("description", F.when(size.isNotNull(), F.struct((-size).alias("size"), "id")))
    return keyed.groupBy("key").agg(F.min_by("name", "id").alias("name"), F.min_by("type", "id").alias("type"), longest.alias("description"), F.coalesce(F.max("degree"), F.lit(0)).cast("bigint").alias("degree"), F.count("*").alias("n"))


def canonical_relations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """``(subject, predicate, object, n)``: relations with their ends' names rewritten to those of the merged entities,
    without loops, equal ones once (the first by chunk and place).

    An end that no entity has keeps its own spelling, trimmed.  Relations: ``(chunk_id, ord, subject, predicate, object)``.
    """
    names = merged_entities(entities).select("key", "name")
    ends = relations.withColumns({"ks": normal_name("subject"), "ko": normal_name("object")})
    ends = ends.join(names.select(F.col("key").alias("ks"), F.col("name").alias("s")), "ks", "left").join(names.select(F.col("key").alias("ko"), F.col("name").alias("o")), "ko", "left")
    rewritten = ends.select("chunk_id", "ord", F.coalesce("s", stripped("subject")).alias("subject"), F.upper("predicate").alias("predicate"), F.coalesce("o", stripped("object")).alias("object"))
    return distinct_relations(rewritten, "subject", "predicate", "object", ["chunk_id", "ord"])


def built_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(key, name, type, n_chunks, degree)`` and edges ``(subject, predicate, object, n)`` drawn from chunks
    ``(id, text)``: entities found and merged, their relations rewritten, degrees counted over the edges."""
    entities = cut(chunk_entities(chunks), "entities")
    edges = cut(canonical_relations(entities, chunk_relations(entities).withColumn("predicate", F.lit("RELATES_TO"))), "relations")
    ends = edges.select(F.explode(F.array(F.lower("subject"), F.lower("object"))).alias("low")).groupBy("low").agg(F.count("*").alias("degree"))
    nodes = merged_entities(entities).withColumn("low", F.lower("name")).join(ends, "low", "left")
    return nodes.select("key", "name", "type", "n_chunks", F.coalesce("degree", F.lit(0)).alias("degree")), edges


def distinct_relations(relations: DataFrame, subject: str, predicate: str, obj: str, order: list[str]) -> DataFrame:
    """The first of all relations that are equal in any case, without loops."""
    keyed = relations.where(F.lower(subject) != F.lower(obj)).withColumns({"_s": F.lower(subject), "_p": F.upper(predicate), "_o": F.lower(obj)})
    first = keyed.groupBy("_s", "_p", "_o").agg(F.min_by(F.struct(subject, predicate, obj), F.struct(*order)).alias("x"), F.count("*").alias("n"))
    return first.select(F.col("x")[subject].alias("subject"), F.col("x")[predicate].alias("predicate"), F.col("x")[obj].alias("object"), "n")


ANSWER = "entities array<struct<name:string,type:string,description:string,confidence:string>>, relations array<struct<subject:string,predicate:string,object:string,description:string,confidence:string>>"


def parse_answers(answers: DataFrame, id_col: str = "chunk_id", text_col: str = "answer") -> tuple[DataFrame, DataFrame]:
    """Entities and relations of a language model's JSON answers, code fences and words around the JSON taken off.

    Entries without a name, or without subject and object, are left out; missing types, predicates and confidences get
    ``CONCEPT``, ``RELATES_TO``, 0.95 and 0.90; an answer that is no JSON gives nothing.
    """
    inner = F.regexp_extract(F.col(text_col), r"(?s)(\{.*\})", 1)
    parsed = answers.select(F.col(id_col).alias("chunk_id"), F.from_json(inner, ANSWER).alias("a"))
    code = lambda c, default: F.regexp_replace(F.upper(stripped(F.when(F.coalesce(stripped(F.col(c)), F.lit("")) == "", default).otherwise(F.col(c)))), r"\s", "_")
    entities = parsed.select("chunk_id", F.posexplode("a.entities").alias("ord", "e")).select("chunk_id", "ord", stripped("e.name").alias("name"), code("e.type", "CONCEPT").alias("type"), "e.description", F.coalesce(F.expr("try_cast(e.confidence AS double)"), F.lit(0.95)).alias("confidence")).where("name <> ''")
    relations = parsed.select("chunk_id", F.posexplode("a.relations").alias("ord", "r")).select("chunk_id", "ord", stripped("r.subject").alias("subject"), code("r.predicate", "RELATES_TO").alias("predicate"), stripped("r.object").alias("object"), "r.description", F.coalesce(F.expr("try_cast(r.confidence AS double)"), F.lit(0.90)).alias("confidence")).where("subject <> '' AND object <> ''")
    return entities, relations
