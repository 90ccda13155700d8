"""Encoding of a whole corpus with a public byte-level BPE vocabulary (problem 7).

A text is split into pieces by the tokenizer's pattern.  The distinct pieces of an
Arrow batch that the worker hasn't met are bucketed by length into padded matrices;
each round every row merges its leftmost pair of least rank, found by a hashed pair
table, and rows without a pair left are compacted away.
"""

from __future__ import annotations

import base64
import heapq
import importlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pieces that a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 400_000
NONE = np.int32(2**31 - 1)
#: Longer pieces, for which a matrix would be nearly empty work, take their pairs in the same order from a heap.
LONG = 256


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed vocabulary files have ``name``."""
    return str(importlib.import_module("public_tokenizers").path(name))


class PairTable:
    """Open-addressing hash table from a pair of ids to the merged id, -1 where none."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1), dtype=np.uint64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.int32)
        todo, at, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(todo):
            self.probes += 1
            free = self.keys[at] == np.uint64(2**64 - 1)
            claimed = np.unique(at[free], return_index=True)[1]
            done = np.flatnonzero(free)[claimed]
            self.keys[at[done]], self.values[at[done]] = keys[todo[done]], merged[todo[done]]
            keep = np.ones(len(todo), dtype=bool)
            keep[done] = False
            todo, at = todo[keep], (at[keep] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged id (= rank) of each pair, NONE where the pair doesn't merge or is padding."""
        keys = (left.astype(np.int64).astype(np.uint64) << np.uint64(32)) | (right.astype(np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF))
        at, out = self._slot(keys), np.full(keys.shape, NONE, dtype=np.int32)
        flat_keys, flat_at, flat_out = keys.ravel(), at.ravel(), out.ravel()
        open_ = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        for _ in range(self.probes):
            there = self.keys[flat_at[open_]]
            hit = there == flat_keys[open_]
            flat_out[open_[hit]] = self.values[flat_at[open_[hit]]]
            open_ = open_[~hit & (there != np.uint64(2**64 - 1))]
            if not len(open_):
                break
            flat_at[open_] = (flat_at[open_] + 1) & ((1 << self.bits) - 1)
        return flat_out.reshape(keys.shape)


class Encoder:
    """Ids of texts by one vocabulary file of ranks (lines of base64 token and rank)."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        triples = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() if len(t) > 1 for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        self.pairs = PairTable(*(np.array(x, dtype=np.int64) for x in zip(*triples, strict=True)))
        self.split = regex.compile(importlib.import_module("public_tokenizers").PATTERN).findall
        self.known: dict[str, tuple[int, ...]] = {}
        #: the pair table as a dictionary, made when a long piece needs it
        self.merged: dict[int, int] | None = None

    def _merge(self, ids: np.ndarray) -> list[np.ndarray]:
        """Ids of one bucket: rows padded with -1 on the right."""
        result: list[np.ndarray | None] = [None] * len(ids)
        rows, rank = np.arange(len(ids)), self.pairs.ranks(ids[:, :-1], ids[:, 1:])
        while len(rows):
            least = rank.min(axis=1) if rank.shape[1] else np.full(len(rows), NONE)
            over = least == NONE
            if over.any():
                for i in np.flatnonzero(over):
                    result[rows[i]] = ids[i][ids[i] >= 0]
                rows, ids, rank, least = rows[~over], ids[~over], rank[~over], least[~over]
                if not len(rows):
                    break
                width = max(1, int((ids >= 0).sum(axis=1).max()))
                ids, rank = ids[:, :width], rank[:, : width - 1]
            at, r = rank.argmin(axis=1), np.arange(len(rows))
            ids[r, at] = least
            col = np.arange(ids.shape[1])[None, :]
            shifted = np.concatenate([ids[:, 1:], np.full((len(rows), 1), -1, dtype=np.int32)], axis=1)
            ids = np.where(col <= at[:, None], ids, shifted)
            if rank.shape[1]:
                moved = np.concatenate([rank[:, 1:], np.full((len(rows), 1), NONE, dtype=np.int32)], axis=1)
                rank = np.where(col[:, :-1] <= at[:, None], rank, moved)
                before, last = np.maximum(at - 1, 0), rank.shape[1] - 1
                rank[r, before] = np.where(at > 0, self.pairs.ranks(ids[r, before], ids[r, before + 1]), rank[r, before])
                here = np.minimum(at, last)
                rank[r, here] = np.where(at <= last, self.pairs.ranks(ids[r, here], ids[r, here + 1]), rank[r, here])
        return result  # type: ignore[return-value]

    def _merge_long(self, piece: np.ndarray) -> tuple[int, ...]:
        """One long piece, merged in the same order as the rows of a matrix: the leftmost of the least pairs first.

        A heap holds the pairs by rank and place, so a merge costs no pass over the piece.
        """
        if self.merged is None:
            there = self.pairs.values != NONE
            self.merged = dict(zip(self.pairs.keys[there].tolist(), self.pairs.values[there].tolist(), strict=True))
        ids, n = piece.tolist(), len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.pairs.ranks(piece[:-1], piece[1:])
        at = np.flatnonzero(rank != NONE)
        heap = [(r, i, ids[i], ids[i + 1]) for r, i in zip(rank[at].tolist(), at.tolist(), strict=True)]
        heapq.heapify(heap)
        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:  # one of the two was merged meanwhile
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (new := self.merged.get((ids[x] << 32) | ids[y])) is not None:
                    heapq.heappush(heap, (new, x, ids[x], ids[y]))
        return tuple(x for x in ids if x >= 0)

    def learn(self, pieces: list[str]) -> None:
        """Compute the ids of pieces not met before."""
        if len(self.known) + len(pieces) > REMEMBERED:
            self.known = {}
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode("utf-8", "surrogatepass")
            if len(b) > LONG:
                self.known[p] = self._merge_long(self.byte_ids[np.frombuffer(b, dtype=np.uint8)])
            else:
                buckets.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append((p, b))
        for width, rows in buckets.items():
            for k in range(0, len(rows), 1 + (1 << 20) // width):
                part = rows[k : k + 1 + (1 << 20) // width]
                flat = np.frombuffer(b"".join(b.ljust(width, b"\0") for _, b in part), dtype=np.uint8).reshape(len(part), width)
                ids = self.byte_ids[flat]
                ids[np.arange(width)[None, :] >= np.array([len(b) for _, b in part])[:, None]] = -1
                for (p, _), x in zip(part, self._merge(ids), strict=True):
                    self.known[p] = tuple(x.tolist())

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; [] for null and for empty texts."""
        out: list[list[int]] = []
        split = [self.split(t) if t else [] for t in texts]
        new = list({p for pieces in split for p in pieces} - self.known.keys())
        keep = self.known
        if new:
            if len(keep) + len(new) > REMEMBERED:
                new = list({p for pieces in split for p in pieces})
            self.learn(new)
        known = self.known
        for pieces in split:
            out.append(list(chain.from_iterable(map(known.__getitem__, pieces))))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Characters of text that are split and merged at a time, so that memory doesn't follow the batch.
CHARACTERS = 2_000_000


def _parts(texts: list[str | None]) -> Iterator[list[str | None]]:
    part: list[str | None] = []
    size = 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size > CHARACTERS:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(df: DataFrame, id_col: str, text_col: str, path: str | None = None) -> DataFrame:
    """Token ids of every row: the id column and ids array<int>, without special tokens.

    A null or empty text has an empty list; strings of special tokens are ordinary
    text; repeated rows stay as many rows.  Whole texts are encoded, of any length.
    Only the two columns are read, so others may have any name.  No shuffle.
    """
    where = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(where)
        for batch in batches:
            done = 0
            for part in _parts(batch.column(1).to_pylist()):
                ids = enc.encode(part)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = pa.array(np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(ends[-1])))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.ListArray.from_arrays(pa.array(ends), flat)], names=[id_col, "ids"])
                done += len(part)

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text_col: str, path: str | None = None, name: str = "n_tokens") -> DataFrame:
    """``df`` without its text, with the number of tokens of each row instead (0 for null and empty)."""
    where, rest = path or vocabulary_path(), [c for c in df.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(where)
        for batch in batches:
            n: list[int] = []
            for part in _parts(batch.column(batch.num_columns - 1).to_pylist()):
                n.extend(map(len, enc.encode(part)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*rest, name])

    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), f"`{name}` bigint"])
    return df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text_col}`")).mapInArrow(run, schema)
