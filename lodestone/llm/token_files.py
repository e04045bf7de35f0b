"""Token-id files: patched frame-of-reference blocks with an index of block starts.

A file holds the ids of documents in ascending order of id, an end id after each.

=========  ==========================================================================
part       content, little-endian
=========  ==========================================================================
magic      8 bytes ``LSPFOR01``
blocks     of up to 128 ids: minimum u32, ids u16, width u8, exceptions u8, the ids less
           the minimum packed at that width from the lowest bit on (padded to bytes),
           then each exception: position u8, high bits u32
index      byte at which each block starts, u64 each
documents  doc_id i64 and number of ids u64 of each
footer     blocks u64, documents u64, byte of the index u64, ids u64
=========  ==========================================================================

The width is the bits that ``PERCENTILE`` of a block's ids need; the others leave their
high bits in the exception list.  Any block can be read alone through the index.

Writing: the documents are dealt by ranges of the id, sorted, encoded and written, one
file a partition, each attempt under a name of its own.  Only the attempt that succeeds
reports its file, so a task that is repeated after a lost executor leaves at worst an
unused file.  The manifest of files is a written table, one row a file.

Texts get the ids that the library gives by default: an added token that a text spells out is one id.

Defined results: a null text counts as empty and has the end id alone; rows of equal id
are ordered by a hash of their text; a null id comes first and is kept as null; an
empty table gives no files.  Columns other than id and text are left out.
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import bounded_batches, new_path, partitions, table, written
from ._text import byte_chunks, ragged
from .byte_bpe import PieceCache, chunk_ids

BLOCK = 128
#: Share of a block's ids that fit its width.
PERCENTILE = 0.9
MAGIC = b"LSPFOR01"
NULL_ID = -(1 << 63)


def pack_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of all ids, the last one perhaps shorter, and the length in bytes of each."""
    n = len(ids)
    if not n:
        return b"", np.zeros(0, np.int64)
    blocks = -(-n // BLOCK)
    sizes = np.full(blocks, BLOCK, np.int64)
    sizes[-1] = n - BLOCK * (blocks - 1)
    padded = np.full(blocks * BLOCK, ids[-1], np.int64)
    padded[:n] = ids
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1)
    rest = grid - low[:, None]
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.int64)  # bits that a value needs; 0 for 0
    wide = np.sort(bits.astype(np.uint8), axis=1, kind="stable")[:, int(np.ceil(PERCENTILE * BLOCK)) - 1].astype(np.int64)
    over = bits > wide[:, None]
    over[-1, sizes[-1] :] = False
    exceptions = over.sum(axis=1)
    packed = [b""] * blocks
    for width in np.unique(wide).tolist():
        rows = np.flatnonzero(wide == width)
        shifts = np.arange(width, dtype=np.uint32)
        for some in np.array_split(rows, -(-len(rows) // 1024)) if width else ():
            planes = ((rest[some].astype(np.uint32)[:, :, None] >> shifts) & np.uint32(1)).astype(np.uint8)
            raw = np.packbits(planes.reshape(len(some), BLOCK * width), axis=1, bitorder="little")
            for r, b in zip(some.tolist(), raw, strict=True):
                packed[r] = b.tobytes()
    if sizes[-1] < BLOCK:
        packed[-1] = packed[-1][: -(-int(sizes[-1] * wide[-1]) // 8)]
    at_row, at_place = np.nonzero(over)
    listed = np.zeros(len(at_row), np.dtype([("at", "u1"), ("high", "<u4")]))
    listed["at"] = at_place
    listed["high"] = rest[at_row, at_place] >> wide[at_row]
    ends = np.cumsum(exceptions)
    lists = [listed[e - c : e].tobytes() for e, c in zip(ends.tolist(), exceptions.tolist(), strict=True)]
    heads = np.zeros(blocks, np.dtype([("low", "<u4"), ("ids", "<u2"), ("width", "u1"), ("exceptions", "u1")]))
    heads["low"], heads["ids"], heads["width"], heads["exceptions"] = low, sizes, wide, exceptions
    out = [h.tobytes() + p + x for h, p, x in zip(heads, packed, lists, strict=True)]
    return b"".join(out), np.fromiter(map(len, out), np.int64, blocks)


def unpack_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """Ids of the blocks that start at these bytes."""
    if not len(starts):
        return np.zeros(0, np.uint32)
    raw = np.frombuffer(data, np.uint8)
    heads = np.frombuffer(raw[starts[:, None] + np.arange(8)].tobytes(), np.dtype([("low", "<u4"), ("ids", "<u2"), ("width", "u1"), ("exceptions", "u1")]))
    sizes, widths = heads["ids"].astype(np.int64), heads["width"].astype(np.int64)
    out = np.zeros((len(starts), BLOCK), np.int64)
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        if width:
            bit = np.arange(BLOCK) * width
            at = starts[rows][:, None] + 8 + (bit >> 3)
            value = np.zeros((len(rows), BLOCK), np.int64)
            for k in range((width + 14) // 8):  # the bytes that a value can reach
                value |= raw[np.minimum(at + k, len(raw) - 1)].astype(np.int64) << (8 * k)
            out[rows] = (value >> (bit & 7)) & ((1 << width) - 1)
    count = heads["exceptions"].astype(np.int64)
    if count.any():
        after = starts + 8 + -(-sizes * widths // 8)
        row = np.repeat(np.arange(len(starts)), count)
        begin = ragged(np.zeros(len(starts), np.int64), count) * 5 + np.repeat(after, count)
        listed = np.frombuffer(raw[begin[:, None] + np.arange(5)].tobytes(), np.dtype([("at", "u1"), ("high", "<u4")]))
        out[row, listed["at"]] += listed["high"].astype(np.int64) << widths[row]
    out += heads["low"].astype(np.int64)[:, None]
    return out[np.arange(BLOCK) < sizes[:, None]].astype(np.uint32)


class FileWriter:
    """Writes one file; ids that don't fill a block wait for the next ones."""

    def __init__(self, stream) -> None:
        self.stream, self.waiting, self.place = stream, np.zeros(0, np.int64), len(MAGIC)
        self.starts: list[np.ndarray] = []
        self.documents: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.ids = 0
        stream.write(MAGIC)

    def add(self, documents: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.documents.append(documents)
        self.counts.append(counts)
        self.ids += len(ids)
        ids = np.concatenate((self.waiting, ids))
        whole = len(ids) // BLOCK * BLOCK
        self._blocks(ids[:whole])
        self.waiting = ids[whole:]

    def _blocks(self, ids: np.ndarray) -> None:
        data, lengths = pack_blocks(ids)
        self.starts.append(self.place + np.cumsum(lengths) - lengths)
        self.place += len(data)
        self.stream.write(data)

    def close(self) -> None:
        self._blocks(self.waiting)
        starts, documents, counts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.starts, self.documents, self.counts))
        rows = np.stack([documents, counts], axis=1) if len(documents) else np.zeros((0, 2), np.int64)
        self.stream.write(starts.astype("<u8").tobytes() + rows.astype("<i8").tobytes())
        self.stream.write(struct.pack("<4Q", len(starts), len(documents), self.place, self.ids))


def open_uri(uri: str, mode: str):
    """A stream of a file in whatever store the URI names."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
    if mode == "r":
        return store.open_input_file(path)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path)


def read_file(uri: str, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yields doc_ids, numbers of ids and the ids of some documents at a time, about so many ids, through the block index."""
    with open_uri(uri, "r") as f:
        size = f.size()
        blocks, documents, index, _ = struct.unpack("<4Q", f.read_at(32, size - 32))
        starts = np.frombuffer(f.read_at(8 * blocks, index), "<u8").astype(np.int64)
        listed = np.frombuffer(f.read_at(16 * documents, index + 8 * blocks), "<i8").reshape(-1, 2)
        ends = np.append(starts[1:], index)
        place = np.concatenate(([0], np.cumsum(listed[:, 1])))
        row = 0
        while row < documents:
            stop = max(int(np.searchsorted(place, place[row] + at_once, "right")) - 1, row + 1)
            part, begin, end = listed[row:stop], int(place[row]), int(place[stop])
            row = stop
            first, last = begin // BLOCK, max(-(-end // BLOCK), begin // BLOCK)
            ids = np.zeros(0, np.uint32)
            if last > first:
                data = f.read_at(int(ends[last - 1] - starts[first]), int(starts[first]))
                ids = unpack_blocks(data, starts[first:last] - starts[first])
            yield part[:, 0], part[:, 1], ids[begin - first * BLOCK : end - first * BLOCK]


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks run side by side as it is
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    return tokenizer, PieceCache(), [token.content.encode() for token in tokenizer.get_added_tokens_decoder().values()]


def library_ids(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids that the library gives for each whole text of a chunk, and how many each text has.

    The library sees the distinct pieces of which the ids aren't known yet; a text in which an added token is spelled out, and
    which it cuts there, it sees whole.
    """
    tokenizer, cache, added = _tokenizer(path)

    def missing(found: list[str]) -> list[list[int]]:
        return [e.ids for e in tokenizer.encode_batch_fast(found, add_special_tokens=False)]

    ids, counts = chunk_ids(data, offsets, missing, cache)
    raw = data.tobytes()
    if any(token in raw for token in added):
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i, (begin, end) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            if any(token in raw[begin:end] for token in added):
                parts[i] = np.array(tokenizer.encode(raw[begin:end].decode(), add_special_tokens=False).ids, np.int32)
        ids, counts = np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
    return ids, counts


def write_token_files(df: DataFrame, path: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes with the tokenizers library and writes the files; returns their manifest.

    The manifest is a written table: uri, first and last id, documents, ids and ``start``, the ids of all files before it.
    Ids of the library for a piece are remembered; it sees every distinct piece that isn't.
    """
    spark = df.sparkSession
    bounded_batches(df.sparkSession)
    folder = new_path(spark, "tokens")
    dealt = (
        df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(partitions(spark), "id", "tie")
        .sortWithinPartitions("id", "tie")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri, writer, stream, rows, first, last = f"{folder}/{uuid.uuid4().hex}.pfor", None, None, 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                stream = open_uri(uri, "w")
                writer = FileWriter(stream)
            numbers = np.asarray(batch.column(0).fill_null(NULL_ID), np.int64)
            first, last, rows = numbers[0] if first is None else first, numbers[-1], rows + len(numbers)
            for row, end, data, offsets in byte_chunks(batch.column(1)):
                ids, counts = library_ids(data, offsets, path)
                whole = np.full(len(ids) + len(counts), end_id, np.int64)
                keep = np.ones(len(whole), bool)
                keep[np.cumsum(counts + 1) - 1] = False
                whole[keep] = ids
                writer.add(numbers[row:end], counts + 1, whole)
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri], "first_id": [int(first)], "last_id": [int(last)], "documents": [rows], "ids": [writer.ids]}, schema=schema)

    schema = pa.schema([("uri", pa.string()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("documents", pa.int64()), ("ids", pa.int64())])
    files = written(dealt.mapInArrow(run, "uri string, first_id long, last_id long, documents long, ids long"), "files")
    before = Window.orderBy("first_id", "last_id", "uri").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens and ids_crc32, decoded from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                for documents, counts, ids in read_file(uri):
                    ends = np.cumsum(counts)
                    raw = memoryview(ids.astype("<u4").tobytes())
                    sums = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(documents, mask=documents == NULL_ID), pa.array(start + ends - counts), pa.array(counts), pa.array(sums, pa.int64())], schema=schema)
                    start += int(counts.sum())

    spread = manifest.select("uri", "start").repartition(partitions(manifest.sparkSession))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """All documents through the files and back."""
    import public_tokenizers

    manifest = write_token_files(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(manifest)
