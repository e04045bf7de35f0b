"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases level by level.  On each level runs of one symbol become one
symbol; deterministic coin tossing then labels every symbol by the lowest bit in which it
differs from the one before, three times over, until eight labels are left; phrases start
at local maxima of the labels, and a phrase is named by a hash of its symbols.  A
boundary depends on a few symbols around it alone, so equal substrings are parsed alike
except near their ends, wherever they stand, and share the names of their inner phrases.

The fingerprint holds the ``SIZE`` least hashes of the names from level ``LEVEL`` up (from level 1 up for texts
of less than ``SHORT`` code points, which have few others), and of the text's last name.  Likeness estimates the
share of names that two texts have in common.  ``signatures`` gives all names of every text, with their levels and places.

Parsing works on all texts of a chunk at once.

Defined results: a null text counts as empty; an empty text has the empty fingerprint, which is
like itself and unlike any other.  Equal texts have equal fingerprints.  Rows stay one by
one; rows of equal id are ordered by a hash of their text, and a null id comes last in
descending order.  In a table of one row the next document is the document itself.  ``fingerprint`` keeps the other
columns; the query leaves them out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded_batches, each_batch, partitions, table
from ._text import mix64, slice_hashes

SIZE = 64
LEVEL = 2
SHORT = 200
_LEAST_ID = -(1 << 63)


def _low_bits() -> np.ndarray:
    """Place of the lowest set bit of every 16-bit number; 16 for 0."""
    out = np.full(1 << 16, 16, np.uint8)
    for place in reversed(range(16)):
        out[1 << place :: 1 << (place + 1)] = place
    return out


_LOW = _low_bits()


def _toss_table() -> np.ndarray:
    """Label of a symbol below 256 after another one, as toss[symbol * 256 + other]."""
    a, b = (x.ravel() for x in np.meshgrid(np.arange(256), np.arange(256), indexing="ij"))
    low = _LOW[a ^ b] & 7
    return (2 * low + ((a >> low) & 1)).astype(np.uint8)


_TOSS = _toss_table()
#: Names of the code points below 65536.
_POINT_NAMES = mix64(np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x1B873593))


def _point_names(points: np.ndarray) -> np.ndarray:
    names = _POINT_NAMES[points.astype(np.uint16)]
    high = np.flatnonzero(points > 0xFFFF)
    names[high] = mix64(points[high].astype(np.uint64) + np.uint64(0x1B873593))
    return names


def _labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Deterministic coin tossing: eight labels at most, no two neighbours of a text alike.

    A text's first symbol is labelled as if the one before it differed in the lowest bit.
    """
    short = symbols.astype(np.uint16)
    differ = np.ones(len(short), np.uint16)
    differ[1:] = short[1:] ^ short[:-1]
    differ[first] = 1
    place = _LOW[differ]
    label = (place << 1) | ((short >> place) & 1).astype(np.uint8)
    rare = np.flatnonzero(place == 16)  # neighbours that differ in higher bits alone
    if len(rare):
        high = symbols[rare] ^ symbols[rare - 1]
        lowest = np.maximum(high & (~high + np.uint64(1)), np.uint64(1))  # 0 only if hashes collide
        at = np.frexp(lowest.astype(np.float64))[1].astype(np.uint64) - np.uint64(1)
        label[rare] = (at * np.uint64(2) + ((symbols[rare] >> at) & np.uint64(1))).astype(np.uint8)
    for _ in range(2):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = label[first] ^ 1
        label = _TOSS[(label.astype(np.uint16) << 8) | before]
    return label


def _phrases(names: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases, and which of them are the first of a text."""
    n = len(names)
    new = first.copy()
    new[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(new)
    symbols = names
    if len(at) < n:
        symbols = names[at]
        runs = np.diff(at, append=n)
        long = np.flatnonzero(runs > 1)
        symbols[long] = mix64(symbols[long] + runs[long].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        first = first[at]
    label = _labels(symbols, first)
    begins = first.copy()
    begins[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~first[2:]  # a text's last symbol is no peak
    starts = np.flatnonzero(begins)
    return slice_hashes(symbols, starts, np.append(starts[1:], len(symbols))), first[starts]


def _levels(points: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level: its number, the names of all texts that aren't done, which of them are the first of a text, those texts, and their numbers of names."""
    alive = np.flatnonzero(np.diff(bounds) > 0)
    names = _point_names(points)
    first = np.zeros(len(names), bool)
    first[bounds[:-1][alive]] = True
    level = 0
    while len(alive):
        counts = np.diff(np.flatnonzero(first), append=len(names))
        yield level, names, first, alive, counts
        if (single := counts == 1).any():  # parsed to the top
            rest = np.repeat(~single, counts)
            names, first, alive = names[rest], first[rest], alive[~single]
            if not len(alive):
                return
        names, first = _phrases(names, first)
        level += 1


def _hashed(names: np.ndarray, level: int) -> np.ndarray:
    return mix64(names ^ np.uint64((level * 0x2545F4914F6CDD1D) & (2**64 - 1))) >> np.uint64(32)


def sketches(points: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Ascending least hashes of the names of each text; ``bounds`` are the places in ``points`` where texts start and end."""
    texts, sizes = len(bounds) - 1, np.diff(bounds)
    kept, kept_doc = [], []
    for level, names, first, alive, counts in _levels(points, bounds):
        if level >= LEVEL:
            kept.append(_hashed(names, level))
            kept_doc.append(np.repeat(alive, counts))
        elif level and (short := np.repeat(sizes[alive] < SHORT, counts)).any():
            kept.append(_hashed(names[short], level))
            kept_doc.append(np.repeat(alive, counts)[short])
        if (single := counts == 1).any():
            kept.append(mix64(names[np.flatnonzero(first)[single]] + np.uint64(0x94D049BB133111EB)) >> np.uint64(32))
            kept_doc.append(alive[single])
    out = [np.zeros(0, np.uint32)] * texts
    if kept:
        value, doc = np.concatenate(kept), np.concatenate(kept_doc)
        code = np.unique((doc.astype(np.uint64) << np.uint64(32)) | value)
        doc, value = (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        begin = np.searchsorted(doc, np.arange(texts + 1))
        for i in np.flatnonzero(sizes > 0).tolist():
            out[i] = value[begin[i] : min(begin[i + 1], begin[i] + SIZE)]
    return out


def fingerprint_text(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of names in common, estimated from the least of both together; 1 for equal sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.unique(np.concatenate((a, b)))
    if max(len(a), len(b)) >= SIZE:
        both = both[:SIZE]  # of what lies behind, one of the two may have forgotten some
    return float(np.isin(both, a, assume_unique=True).astype(int) @ np.isin(both, b, assume_unique=True) / len(both))


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))


def _parse(texts: list[str]) -> list[np.ndarray]:
    return sketches(*_points(texts))


def _groups(sizes: list[int], most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most or i == len(sizes) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of every text; a column of that name is replaced."""
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c != out]

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in batch.column(batch.schema.names.index(text)).to_pylist()]
        for row, end in _groups([len(t) for t in texts]):
            prints = pa.array([fingerprint_text(s) for s in _parse(texts[row:end])])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)).slice(row, end - row) for c in kept), prints], [*kept, out])

    return df.mapInArrow(each_batch(run), T.StructType([df.schema[c] for c in kept] + [T.StructField(out, T.StringType())]))


def signatures(df: DataFrame, text: str = "text", out: str = "names") -> DataFrame:
    """Adds the names of all phrases of every text from level 1 up: an array of (level, name), level by level in the order of the text.

    Equal substrings have equal names but near their ends; so a passage that two texts share shows, however long they are.  A column of that name is replaced.
    """
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c != out]
    kind = T.ArrayType(T.StructType([T.StructField("level", T.IntegerType()), T.StructField("name", T.LongType())]), False)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t or "" for t in batch.column(batch.schema.names.index(text)).to_pylist()]
        for row, end in _groups([len(t) for t in texts]):
            names, levels, docs = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
            for level, found, _, alive, counts in _levels(*_points(texts[row:end])):
                if level:
                    names.append(found.view(np.int64))
                    levels.append(np.full(len(found), level, np.int32))
                    docs.append(np.repeat(alive, counts))
            doc = np.concatenate(docs)
            order = np.argsort(doc, kind="stable")
            flat = pa.StructArray.from_arrays([pa.array(np.concatenate(levels)[order]), pa.array(np.concatenate(names)[order])], ["level", "name"])
            offsets = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=end - row)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.names.index(c)).slice(row, end - row) for c in kept), pa.ListArray.from_arrays(pa.array(offsets), flat)], [*kept, out])

    return df.mapInArrow(each_batch(run), T.StructType([df.schema[c] for c in kept] + [T.StructField(out, kind)]))


def _places(ids: pa.Array, ties: pa.Array) -> np.ndarray:
    """Sixteen bytes for each row that ascend as the id descends and then the tie ascends."""
    sign = np.uint64(1 << 63)
    both = np.stack([~np.asarray(ids, np.int64).view(np.uint64) ^ sign, np.asarray(ties, np.int64).view(np.uint64) ^ sign], axis=1)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def _cuts(quantiles: list[int]) -> np.ndarray:
    """Places of the cuts, in order; an id that is several quantiles is cut between by its ties, which are hashes."""
    ids, counts = np.unique(np.array(quantiles, np.int64), return_counts=True)
    ties = [np.array([int((i + 1) * 2**64 / (c + 1)) - 2**63 for i in range(c)] if c > 1 else [-(2**63)], np.int64) for c in counts.tolist()]
    return np.unique(_places(np.repeat(ids, counts), np.concatenate(ties))) if len(ids) else np.zeros(0, "S16")


def with_next(df: DataFrame, run, schema: str) -> DataFrame:
    """Applies ``run`` to an iterator of (doc_id, text, ahead) in descending order of id, rows of one id by a hash of the text, dealt by ranges of both.

    After the rows of a range comes the first row of the next one (after the last range: of the first), marked ``ahead``: a task
    sees every row of its own together with the one that follows it.  The driver holds three numbers for each range.
    """
    n = partitions(df.sparkSession)
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST_ID))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), key.alias("k"), F.xxhash64(text).alias("tie"))
    shares = [i / n for i in range(1, n)] or [0.5]
    cuts = _cuts(rows.select(F.percentile_approx("k", shares, 100 * n)).first()[0] or [])

    def ranges(ids: pa.Array, ties: pa.Array) -> np.ndarray:
        return np.searchsorted(cuts, _places(ids, ties), "right").astype(np.int32)

    range_of = F.arrow_udf(lambda ids, ties: pa.array(ranges(ids, ties)), "int")
    heads = rows.select(range_of("k", "tie").alias("r"), F.bitwise_not("k").alias("down"), "tie").groupBy("r").agg(F.min(F.struct("down", "tie")).alias("head")).collect()
    heads = sorted((h["r"], ~h["head"]["down"], h["head"]["tie"]) for h in heads)
    first = _places(pa.array([h[1] for h in heads], pa.int64()), pa.array([h[2] for h in heads], pa.int64()))
    own = np.array([h[0] for h in heads], np.int32)

    def before(ids: pa.Array, ties: pa.Array) -> pa.Array:
        """The range before, which a head goes to as well; the first range comes after the last."""
        at = np.searchsorted(own, ranges(ids, ties))
        return pa.array(np.roll(own, 1)[at], mask=first[at] != _places(ids, ties))

    dealt = rows.withColumn("r", range_of("k", "tie")).withColumn("to", F.arrow_udf(before, "int")("k", "tie"))
    dealt = dealt.select("doc_id", "text", "k", "tie", F.posexplode(F.array_compact(F.array("r", "to"))).alias("ahead", "r"))
    dealt = dealt.repartitionById(len(cuts) + 1, "r").sortWithinPartitions("r", "ahead", F.desc("k"), "tie")
    return dealt.select("doc_id", "text", (F.col("ahead") > 0).alias("ahead")).mapInArrow(run, schema)


def edit(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following one."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how like they are."""
    bounded_batches(spark)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def rows(ids: list, texts: list[str], ahead: str) -> pa.RecordBatch:
        """Rows of some documents; ``ahead`` follows the last of them."""
        edited = [edit(t, f) for t, f in zip(texts, [*texts[1:], ahead], strict=True)]
        parsed = _parse([*texts, *edited, ahead])
        own, changed = parsed[: len(texts)], parsed[len(texts) : -1]
        following = [*own[1:], parsed[-1]]
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
            pa.array([fingerprint_text(s) for s in own]),
            pa.array([fingerprint_text(s) for s in changed]),
            pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)]),
            pa.array([likeness(a, b) for a, b in zip(own, following, strict=True)]),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for batch in batches:
            for i, text, ahead in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if texts and (ahead or size >= 1 << 18):
                    yield rows(ids, texts, text)
                    ids, texts, size = [], [], 0
                if not ahead:
                    ids.append(i)
                    texts.append(text)
                    size += len(text)

    return with_next(table(spark, sf_dir, "documents"), run, schema)
