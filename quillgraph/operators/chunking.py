"""Chunks of notes: sentences packed up to a size, with the last sentences carried over."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.text import sentences

TARGET, OVERLAP, LEAST = 256, 40, 20
CHUNK = "note_id string, chunk_index int, text string, start_char int, end_char int, token_count int"


def estimate(text: str) -> int:
    """About 1.3 tokens a word, 1 at least."""
    return max(1, len(text.split()) * 13 // 10)


def pack(body: str, parts: list[str], target: int = TARGET, overlap: int = OVERLAP, least: int = LEAST) -> list[tuple[str, int, int, int]]:
    """``(text, start, end, tokens)`` of each chunk.

    A chunk is closed when the next sentence would take it beyond the target; it is kept if it has ``least`` tokens, and
    its last sentences of ``overlap`` tokens at most open the next one.  Closed chunks count the sum over sentences, the
    last one counts its whole text.  Places are those of the chunk's first 30 characters in the body.
    """
    out: list[tuple[str, int, int, int]] = []
    held: list[tuple[str, int]] = []

    def close(tokens: int | None) -> None:
        text = " ".join(s for s, _ in held).strip()
        start = body.find(text[:30])
        out.append((text, max(0, start), max(0, start) + len(text) if start >= 0 else len(text), estimate(text) if tokens is None else tokens))

    for sentence in parts:
        size = estimate(sentence)
        count = sum(n for _, n in held)
        if held and count + size > target:
            if count >= least:
                close(count)
            carried, total = 0, 0
            while carried < len(held) and total + held[-1 - carried][1] <= overlap:
                total += held[-1 - carried][1]
                carried += 1
            held = held[len(held) - carried :]
        held.append((sentence, size))
    if held:
        close(None)
    return out


def chunk_notes(notes: DataFrame, id_col: str = "id", text_col: str = "raw_content") -> DataFrame:
    """Chunks of every note; the sentences are split by Spark, the fold over one note's sentences runs in Arrow batches.

    Null, empty and blank texts have no chunks.
    """
    schema = pa.schema([("note_id", pa.string()), ("chunk_index", pa.int32()), ("text", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("token_count", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text, parts in zip(*(c.to_pylist() for c in batch.columns)):
                rows.extend((key, i, *chunk) for i, chunk in enumerate(pack(text, parts)))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

    return notes.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(text_col), sentences(text_col).alias("parts")).mapInArrow(run, CHUNK)
