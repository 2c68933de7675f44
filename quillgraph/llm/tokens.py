"""Encoding of a corpus with a public byte-level tokenizer (problem 6).

A task takes the texts of its partition batch by batch.  The different words of a batch that the worker has not met are
laid out in one row of token positions, and an index from each pair's rank to all positions of that pair is kept.  The
active ranks are applied in ascending order; every application changes all positions of the pair at once and updates only
the lists of the neighbouring pairs.  No shuffle is needed.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "byte_bpe_50k.json"
#: Different words that a worker keeps encoded; beyond it the memory is emptied and filled anew (no result changes).
KEPT_WORDS = 1_000_000
_NONE = np.int64(1 << 40)


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the installed package of public tokenizers keeps ``name``."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def split_pattern() -> str:
    """The public tokenizers' pattern of words."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shifted = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(shifted)}


class PairTable:
    """The tokenizer's merges as arrays: a pair's rank, and the token that a rank makes."""

    def __init__(self, path: str) -> None:
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, alphabet = model["vocab"], byte_alphabet()
        self.byte_ids = np.zeros(256, np.int64)
        for char, byte in alphabet.items():
            self.byte_ids[byte] = vocab[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = (left << 20) | right
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], order.astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``_NONE`` where the pair is no merge."""
        keys = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank_of[at], _NONE)


def merge_words(words: list[bytes], pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words on end, and the number of each word's tokens, by the pair occurrence index."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    raw = np.frombuffer(b"".join(words), np.uint8)
    n = len(raw)
    if not n:
        return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
    token = pairs.byte_ids[raw]
    ends = np.cumsum(sizes)
    after = np.arange(1, n + 1)
    before = np.arange(-1, n - 1)
    filled = sizes > 0
    after[ends[filled] - 1] = -1
    before[(ends - sizes)[filled]] = -1
    alive = np.ones(n, bool)
    rank = np.full(n, _NONE)
    has = np.flatnonzero(after >= 0)
    rank[has] = pairs.rank(token[has], token[after[has]])
    places: dict[int, list[np.ndarray]] = {}
    active: list[int] = []

    def note(at: np.ndarray) -> None:
        ranks = rank[at]
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        upto = int(np.searchsorted(ranks, _NONE))
        if not upto:
            return
        starts = np.flatnonzero(np.concatenate(([True], ranks[1:upto] != ranks[: upto - 1])))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), upto]):
            r = int(ranks[s])
            if r in places:
                places[r].append(at[s:e])
            else:
                places[r] = [at[s:e]]
                heapq.heappush(active, r)

    note(has)
    while active:
        r = heapq.heappop(active)
        lists = places.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        at = at[(rank[at] == r) & alive[at]]
        if len(at) > 1:
            joined = np.concatenate(([False], after[at[:-1]] == at[1:]))  # a pair that begins within the one before
            if joined.any():
                index = np.arange(len(at))
                run = np.maximum.accumulate(np.where(joined, 0, index))
                at = at[(index - run) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        token[at] = pairs.made[r]
        alive[gone] = False
        rank[gone] = _NONE
        follow = after[gone]
        after[at] = follow
        linked = follow >= 0
        before[follow[linked]] = at[linked]
        prior = before[at]
        touched = np.concatenate((at, prior[prior >= 0]))
        touched = touched[alive[touched]]
        if len(touched) > 1:
            touched = np.unique(touched)
        nxt = after[touched]
        fresh = np.full(len(touched), _NONE)
        inner = nxt >= 0
        fresh[inner] = pairs.rank(token[touched[inner]], token[nxt[inner]])
        rank[touched] = fresh
        note(touched[fresh < _NONE])
    counts = np.zeros(len(words), np.int64)
    counts[filled] = np.add.reduceat(alive.astype(np.int64), (ends - sizes)[filled])
    return token[alive].astype(np.int32), counts


class Encoder:
    """Keeps the ids of the words a worker has met; encodes batches of texts."""

    def __init__(self, path: str, pattern: str) -> None:
        import re

        import regex

        self.pairs, self.words_of = PairTable(path), regex.compile(pattern).findall
        self.uneven = re.compile(r" (?=\s)|\s(?= )|\A | \Z").search
        self.split = re.compile(r"(?<=\S) (?=\S)").split
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, parts: list[str]) -> None:
        """Encode parts of texts that are not known yet."""
        words: dict[str, int] = {}
        spans: list[int] = []
        flat: list[int] = []
        for part in parts:
            found = self.words_of(part)
            spans.append(len(found))
            flat.extend([words.setdefault(w, len(words)) for w in found])
        ids, counts = merge_words([w.encode("utf-8") for w in words], self.pairs)
        begin = np.cumsum(counts) - counts
        picks = np.array(flat, np.int64)
        new_ids, word_lengths = gather(ids, begin[picks], counts[picks]) if len(picks) else (ids[:0], picks)
        edges = np.concatenate(([0], np.cumsum(word_lengths)))
        upto = np.concatenate(([0], np.cumsum(spans)))
        part_edges = edges[upto]
        base = len(self.flat)
        for i, part in enumerate(parts):
            self.code[part] = len(self.start) + i
        self.flat = np.concatenate((self.flat, new_ids))
        self.start = np.concatenate((self.start, base + part_edges[:-1]))
        self.length = np.concatenate((self.length, np.diff(part_edges)))

    def codes(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the parts of all texts on end, and each text's number of parts (none for null and empty texts)."""
        parts: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if text:
                # a text may be cut before any single space between other characters: no word reaches over it
                own = self.split(text) if self.uneven(text) else text.split(" ")
                counts[i] = len(own)
                parts.append(own[0])
                parts.extend([" " + x for x in own[1:]])
        if len(self.code) > KEPT_WORDS:
            self.clear()
        fresh = set(parts).difference(self.code)
        if fresh:
            self.learn(sorted(fresh))
        return np.fromiter(map(self.code.__getitem__, parts), np.int64, len(parts)), counts

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and each text's number of ids."""
        codes, counts = self.codes(texts)
        ids, lengths = gather(self.flat, self.start[codes], self.length[codes])
        return ids, np.diff(np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))])

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Each text's number of ids."""
        codes, counts = self.codes(texts)
        sums = np.concatenate(([0], np.cumsum(self.length[codes])))
        return np.diff(sums[np.concatenate(([0], np.cumsum(counts)))])


def gather(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``flat[start:start + length]`` on end, and their lengths."""
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start - ends + length, length)], length


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The worker's encoder; workers are reused by later tasks."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(id_col, ids)`` with the ids of each row's whole text, without special tokens.

    Null and empty texts get an empty list; blank texts are encoded like any other.  One row per input row; other columns
    are not read, so clashing names do no harm.
    """
    path, pattern = path or tokenizer_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            ids, counts = own.encode(batch.column(1).to_pylist())
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``(id_col, n_tokens)``: the length of each text's encoding, 0 for null and empty texts."""
    path, pattern = path or tokenizer_path(), pattern or split_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own.count(batch.column(1).to_pylist()))], names=[id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint")
