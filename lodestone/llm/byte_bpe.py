"""Byte-level BPE encoding and decoding from a file of ranks.

Pre-tokenisation is vectorised (``pretokens``): the slices of a chunk are reduced
to its distinct pieces, and each of those is looked up in a cache or merged pair
by pair.  Ids of a document are gathered from the pieces' ids, and the byte
offset at which each token ends is kept: with it a range of tokens decodes to a
range of the text without a scan.

Defined results: a null text counts as empty and has no tokens; rows stay as they
are, repeated ones too; a text of any length is taken whole.  Columns of the input
other than the text pass through; a column of an output's name is replaced.
"""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import binary_slices, bounded_batches, each_batch, ragged_list, table
from ._text import byte_chunks, ragged
from .pretokens import pieces

#: Pieces of which a worker remembers the ids; twice as many at most, some 40 bytes each.
CACHE_PIECES = 400_000


class Generation:
    """Ids of pieces by the pieces' 64-bit hash, in flat arrays."""

    def __init__(self) -> None:
        self.keys, self.starts, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the keys are, and which of them are there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return at, self.keys[at] == keys

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Distinct ascending keys that aren't there yet, and their ids one after the other."""
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids[: self.used], np.zeros(len(self.ids) + 2 * len(ids), np.int32)))
        self.ids[self.used : self.used + len(ids)] = ids
        starts = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.starts, self.counts = (np.insert(x, place, y) for x, y in ((self.keys, keys), (self.starts, starts), (self.counts, counts)))


class PieceCache:
    """Two generations: what hasn't been asked for during a whole generation is forgotten."""

    def __init__(self, limit: int = CACHE_PIECES) -> None:
        self.limit, self.young, self.old = limit, Generation(), Generation()

    def ids_of(self, keys: np.ndarray, encode_missing: Callable[[np.ndarray], list[list[int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and number of the ids of each of these distinct keys, and the array in which they are.

        ``encode_missing`` gets the places of the keys that aren't known and gives the ids of each.
        """
        if len(self.young.keys) + len(keys) > self.limit or self.young.used > 8 * self.limit:
            self.old, self.young = self.young, Generation()
        order = np.argsort(keys)
        keys = keys[order]
        unknown = np.flatnonzero(~self.young.find(keys)[1])
        at, there = self.old.find(keys[unknown])
        if there.any():
            at = at[there]
            self.young.add(keys[unknown[there]], self.old.counts[at], self.old.ids[ragged(self.old.starts[at], self.old.counts[at])])
        missing = unknown[~there]
        if len(missing):
            lists = encode_missing(order[missing])
            self.young.add(keys[missing], np.fromiter(map(len, lists), np.int64, len(lists)), np.fromiter(chain.from_iterable(lists), np.int32))
        at = np.empty(len(keys), np.int64)
        at[order] = self.young.find(keys)[0]
        return self.young.starts[at], self.young.counts[at], self.young.ids


class Ranks:
    """The vocabulary: bytes to id, and the merges that the ranks imply."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        size = max(self.ids.values()) + 1
        tokens = [b""] * size
        for token, i in self.ids.items():
            tokens[i] = token
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.places = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the pair of lowest rank merges first, the leftmost among equals."""
        ids = self.ids
        if (whole := ids.get(piece)) is not None:
            return [whole]
        return self._merge_short(piece) if len(piece) <= 64 else self._merge_long(piece)

    def _merge_short(self, piece: bytes) -> list[int]:
        rank = self.ids.get
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank(a + b, 1 << 30) for a, b in zip(parts, parts[1:])]
        while pairs and (best := min(pairs)) < 1 << 30:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], 1 << 30)
        return [self.ids[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        n, rank = len(piece), self.ids.get
        end = list(range(1, n + 1))  # where the part that starts here ends; 0 once it is merged away
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)

        def push(i: int) -> None:
            if i >= 0 and end[i] < n and (r := rank(piece[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            if not end[i] or end[i] >= n or end[end[i]] != stop:
                continue
            gone = end[i]
            end[i], end[gone] = end[gone], 0
            if end[i] < n:
                before[end[i]] = i
            push(i)
            push(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ids[piece[i : end[i]]])
            i = end[i]
        return out


@functools.lru_cache(maxsize=4)
def _ranks(path: str) -> tuple[Ranks, PieceCache]:
    return Ranks(path), PieceCache()


def chunk_ids(data: np.ndarray, offsets: np.ndarray, encode_missing: Callable[[list[str]], list[list[int]]], cache: PieceCache) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a chunk, and how many each text has.

    ``encode_missing`` gets the distinct pieces that the cache doesn't know and gives a list of ids for each.
    """
    text, starts, ends, first, codes, fresh, keys = pieces(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
    begin, stop = starts[fresh], ends[fresh]
    at, counts, known = cache.ids_of(keys, lambda which: encode_missing([text[s:e] for s, e in zip(begin[which].tolist(), stop[which].tolist(), strict=True)]))
    counts = counts[codes]
    sums = np.concatenate(([0], np.cumsum(counts)))
    return known[ragged(at[codes], counts)], sums[first[1:]] - sums[first[:-1]]


def _decoded(ranks: Ranks, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The bytes of the tokens of each row; ``counts`` are the tokens of a row."""
    lengths = ranks.lengths[ids]
    sums = np.concatenate(([0], np.cumsum(lengths)))
    ends = np.cumsum(counts)
    return binary_slices(ranks.blob[ragged(ranks.places[ids], lengths)], sums[ends] - sums[ends - counts]).cast(pa.binary())


def encode(df: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """Adds ``token_ids`` (array of int) and ``token_ends`` (array of int: the byte at which each token ends).

    With ``decoded`` also what the ids decode to (binary), out of the ids alone: the round trip in one pass.
    """
    bounded_batches(df.sparkSession)
    added = ["token_ids", "token_ends", *["decoded"] * decoded]
    kept = [c for c in df.columns if c not in added]
    kinds = [T.ArrayType(T.IntegerType(), False), T.ArrayType(T.IntegerType(), False), T.BinaryType()]
    out = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, k) for n, k in zip(added, kinds, strict=False)])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ranks, cache = _ranks(path)
        for row, end, data, offsets in byte_chunks(batch.column(batch.schema.get_field_index(text))):
            ids, counts = chunk_ids(data, offsets, lambda found: [ranks.merge(p.encode()) for p in found], cache)
            ends = np.cumsum(ranks.lengths[ids])
            ends -= np.repeat(offsets[:-1], counts)
            columns = [batch.column(batch.schema.get_field_index(c)).slice(row, end - row) for c in kept]
            made = [ragged_list(ids, counts, pa.int32()), ragged_list(ends.astype(np.int32), counts, pa.int32()), *([_decoded(ranks, ids, counts)] if decoded else [])]
            yield pa.RecordBatch.from_arrays([*columns, *made], [*kept, *added])

    return df.mapInArrow(each_batch(run), out)


def decode(df: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """Adds ``decoded`` (binary), the bytes of the tokens in a row; null ids count as none."""
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c != "decoded"]
    out = T.StructType([df.schema[c] for c in kept] + [T.StructField("decoded", T.BinaryType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ranks, _ = _ranks(path)
        step = 2000
        for row in range(0, batch.num_rows, step):
            part = batch.slice(row, step)
            lists = part.column(part.schema.get_field_index(ids))
            found = _decoded(ranks, np.asarray(lists.flatten(), np.int64), np.asarray(lists.value_lengths().fill_null(0), np.int64))
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), found], [*kept, "decoded"])

    return df.mapInArrow(each_batch(run), out)


def op10_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every document's ids and the digest of what they decode to."""
    import public_tokenizers

    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded=True).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
