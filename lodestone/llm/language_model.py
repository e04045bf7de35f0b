"""Language-model scores by deleted interpolation.

A token's probability after the token before it mixes three maximum-likelihood
estimates, with weights that depend on how often the context was learned:

    P(w | u) = a(b) * c(u, w) / c(u)
             + b(b) * c(w) / N
             + c(b) / (V + 1)

``c`` counts tokens and pairs of neighbours, ``N`` all tokens, ``V`` the distinct ones; ``b``
is the bucket of the context's count, by powers of two, and a context never learned has no
first part.  A text begins after a mark of its own and ends with an end token.

Counts come from all learned documents.  For the weights, one tenth of those is held
out: its tokens are scored by the counts of the other documents, and
expectation-maximisation finds the weights of each bucket that make them likeliest.  The
held-out tokens are gathered over (bucket, level of the bigram estimate, level of the
unigram estimate), a table of fixed size, so that EM runs over sums and not over rows.

How counts meet the texts: documents are written as chunks of about 1 MB, each with its
distinct words and its tokens as places among them.  A chunk asks once for each distinct
word and each distinct pair it has, and says how often it has them; what is asked for is
dealt by ranges of the hash, summed, and answered to each chunk in the order it asked.  So
however frequent a word, a pair or a context is, it is one entry a chunk, and neither a
table of words nor one of pairs is held anywhere as a whole.

Size of what is shared: pairs of two frequent words, those of at least ``CLASS_SHARE`` of
all tokens, aren't asked for but counted in one table of at most (1 / CLASS_SHARE + 2)
squared cells, which is broadcast.

Defined results: null texts count as empty and have the end token alone; repeated rows
are scored one by one and counted each time; an id that is null is a row of fold 0, that
is, never learned from.  With no learned document every token has the third part alone.
Words and pairs are compared by 64-bit hashes.  The input's other columns are left out.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import bounded_batches, each_batch, fold, partitions, release, table, written
from ._text import Words, byte_chunks, mix64

#: Texts whose distinct words and pairs are asked for together: the larger, the less is asked for twice.
ASKING_BYTES = 1 << 20
CLASS_SHARE = 2.0**-10
BUCKETS = 48
#: Levels of an estimate, two for each halving.
LEVELS = 64
EM_STEPS = 60
#: Learned tokens for each range of hashes, so that a task's memory doesn't grow with the input.
RANGE_TOKENS = 1 << 19
_MARK = np.uint64(0x51AFD7ED558CCD01)  # before the first token of a text
_ENDED = np.uint64(0x2545F4914F6CDD1D)  # the end token
_PAIR = np.uint64(0x9FB21C651E98DF25)
_NEW, _KEPT, _HELD = 0, 1, 2  # a chunk's documents: not learned, learned, learned and held out for the weights


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end token after each text, and the first token of each text."""
    words = Words(data, offsets, alnum=False)
    texts = len(offsets) - 1
    bounds = words.bounds + np.arange(texts + 1)
    out = np.empty(len(words.hashes) + texts, np.uint64)
    end = np.zeros(len(out), bool)
    end[bounds[1:] - 1] = True
    out[end] = _ENDED
    out[~end] = words.hashes
    return out, bounds


@dataclass
class Model:
    """What a scorer needs; ``common`` is sorted by hash."""

    common: np.ndarray
    classes: np.ndarray  # class of each frequent word; 0 stands for all others
    cells: np.ndarray  # learned bigrams by class of the context (the mark's is the last) and of the word
    unigrams: np.ndarray  # tokens of each class
    buckets: np.ndarray  # bucket of each class as a context
    weights: np.ndarray  # of the three parts, by bucket
    total: int
    distinct: int
    learned: tuple | None = None  # the documents, their chunks and the answers to them; stays with the driver

    def parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By classes of context and word: factor of c(w), and the constant part by context.

        Class 0 isn't one word: its bigrams are in the answers, and its column has the unigram part alone.
        """
        rows = self.cells.sum(axis=1, keepdims=True)
        given = self.cells / np.maximum(rows, 1) / np.maximum(self.unigrams, 1)[None, :]
        given[:, 0] = 0
        a, b, c = (self.weights[self.buckets, k][:, None] for k in range(3))
        factor = a * given + b / max(self.total, 1)
        return factor, (c / (self.distinct + 1))[:, 0], rows[:, 0]


def _lookup(common: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each hash among the common ones, and whether it is one."""
    if not len(common):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return at, common[at] == hashes


def _bucket(counts: np.ndarray) -> np.ndarray:
    """Bucket of a context by its count; 0 for one never learned."""
    return np.where(counts > 0, np.minimum(1 + np.floor(np.log2(np.maximum(counts, 1))), BUCKETS - 1), 0).astype(np.int64)


def count_words(df: DataFrame) -> DataFrame:
    """Counts of the tokens of rows with ``learn``, by hash; combined for each batch before the shuffle."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        learn = np.asarray(batch.column("learn").to_numpy(zero_copy_only=False), bool)
        parts = []
        for row, end, data, offsets in byte_chunks(batch.column("text")):
            tokens, bounds = _tokens(data, offsets)
            parts.append(tokens[np.repeat(learn[row:end], np.diff(bounds))])
        keys, sums = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sums, pa.int64())], ["word", "n"])

    return df.mapInArrow(each_batch(run), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pack(values: np.ndarray) -> bytes:
    """Unsigned numbers by planes of bytes, as few as the largest needs, so that high zeros compress."""
    width = np.min_scalar_type(int(values.max(initial=0))).itemsize
    return np.ascontiguousarray(values.astype(f"<u{width}")).view(np.uint8).reshape(len(values), width).T.tobytes()


def _unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(-1, n)
    return np.ascontiguousarray(planes.T).view(f"<u{len(planes)}").ravel().astype(np.uint64)


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


_CHUNK = "chunk long, kind int, ids array<long>, sizes binary, n_types int, types binary, tokens binary"


def chunked(df: DataFrame) -> DataFrame:
    """Chunks of documents (doc_id, text, learn, held) of one kind: ids, sizes, distinct words and tokens. To be written, as their names are drawn."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        learn, held = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), bool) for c in ("learn", "held"))
        kinds = np.where(learn, np.where(held, _HELD, _KEPT), _NEW)
        for kind in np.unique(kinds).tolist():
            rows = batch.filter(pa.array(kinds == kind))
            for row, end, data, offsets in byte_chunks(rows.column("text"), ASKING_BYTES):
                tokens, bounds = _tokens(data, offsets)
                types, at = np.unique(tokens, return_inverse=True)
                columns = [
                    pa.array([uuid.uuid4().int >> 65]),
                    pa.array([kind], pa.int32()),
                    pa.array([rows.column("doc_id").slice(row, end - row).to_pylist()], pa.list_(pa.int64())),
                    pa.array([_pack(np.diff(bounds))], pa.binary()),
                    pa.array([len(types)], pa.int32()),
                    pa.array([_pack(_gaps(types))], pa.binary()),
                    pa.array([_pack(at)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", "kind", "ids", "sizes", "n_types", "types", "tokens"])

    return df.select("doc_id", "text", "learn", "held").mapInArrow(each_batch(run), _CHUNK)


class Chunk:
    """A row of ``chunked``: what it asks for, and what the answers say of its tokens."""

    def __init__(self, row: dict, common: np.ndarray, kinds: np.ndarray, classes: int) -> None:
        self.kind, self.ids = row["kind"], row["ids"]
        self.sizes = _unpack(row["sizes"], len(self.ids)).astype(np.int64)
        self.types = np.cumsum(_unpack(row["types"], row["n_types"]), dtype=np.uint64)
        self.tokens = _unpack(row["tokens"], int(self.sizes.sum())).astype(np.int64)
        self.context = np.empty_like(self.tokens)
        self.context[1:] = self.tokens[:-1]
        self.context[np.cumsum(self.sizes) - self.sizes] = len(self.types)  # the mark
        at, known = _lookup(common, self.types)
        kind = np.append(np.where(known, kinds[at] if len(kinds) else 0, 0), classes)
        self.row, self.column = kind[self.context], kind[self.tokens]
        self.asked = (self.row == 0) | (self.column == 0)  # the others are pairs of the table

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The words and pairs to ask for, by hash, and how often they are here."""
        hashes = np.append(self.types, _MARK)
        pairs = mix64(hashes[self.context[self.asked]] * _PAIR + self.types[self.tokens[self.asked]])
        distinct, self._at, n = np.unique(pairs, return_inverse=True, return_counts=True)
        both = np.concatenate((self.types, distinct))
        self._order = np.argsort(both, kind="stable")
        return both[self._order], np.concatenate((np.bincount(self.tokens, minlength=len(self.types)), n))[self._order]

    def counts(self, answers: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each token: the count of its pair, of its context and of itself. ``answers`` are in the order of ``keys``."""
        found = np.empty(len(answers), np.int64)
        found[self._order] = answers
        words = np.append(found[: len(self.types)], cells[-1].sum())
        pair = cells[self.row, self.column]
        pair[self.asked] = found[len(self.types) :][self._at]
        return pair, words[self.context], words[self.tokens]


def _edges(ranges: int) -> np.ndarray:
    return np.arange(1, ranges, dtype=np.uint64) * np.uint64((1 << 64) // ranges)


def answered(chunks: DataFrame, shared, classes: int, ranges: int) -> DataFrame:
    """To each chunk and range of hashes: learned counts of what it asked for, and for held-out chunks those of the held-out ones."""

    def ask(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in batch.to_pylist():
            keys, counts = Chunk(row, *shared.value, classes).keys()
            at = np.concatenate(([0], np.searchsorted(keys, _edges(ranges)), [len(keys)]))
            parts = np.flatnonzero(np.diff(at))
            slices = [slice(at[p], at[p + 1]) for p in parts]
            columns = [
                pa.array(parts.astype(np.int32)),
                pa.array([row["chunk"]] * len(parts), pa.int64()),
                pa.array([row["kind"]] * len(parts), pa.int32()),
                pa.array(np.diff(at)[parts].astype(np.int32)),
                pa.array([_pack(_gaps(keys[x])) for x in slices], pa.binary()),
                pa.array([_pack(counts[x]) for x in slices], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["part", "chunk", "kind", "n", "keys", "counts"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task has all that was asked for in its ranges, one range after the other."""
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "kind", "n")), *([x.as_buffer() for x in batch.column(c)] for c in ("keys", "counts")), strict=True):
                if rows and r[0] != rows[0][0]:
                    yield of_range(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield of_range(rows)
        del rows
        release()

    def of_range(rows: list[tuple]) -> pa.RecordBatch:
        keys = np.concatenate([np.cumsum(_unpack(r[4], r[3]), dtype=np.uint64) for r in rows])
        counts = np.concatenate([_unpack(r[5], r[3]).astype(np.int64) for r in rows])
        kinds = np.repeat([r[2] for r in rows], [r[3] for r in rows])
        _, at = np.unique(keys, return_inverse=True)
        del keys
        total, held = (np.bincount(at, np.where(which, counts, 0)).astype(np.int64)[at] for which in (kinds != _NEW, kinds == _HELD))
        ends = np.cumsum([r[3] for r in rows])
        slices = [slice(end - r[3], end) for r, end in zip(rows, ends, strict=True)]
        columns = [
            pa.array([r[1] for r in rows], pa.int64()),
            pa.array([r[2] for r in rows], pa.int32()),
            pa.array([r[0] for r in rows], pa.int32()),
            pa.array([r[3] for r in rows], pa.int32()),
            pa.array([_pack(total[x]) for x in slices], pa.binary()),
            pa.array([_pack(held[x]) if r[2] == _HELD else None for r, x in zip(rows, slices, strict=True)], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["chunk", "kind", "part", "n", "total", "held"])

    asked = chunks.mapInArrow(each_batch(ask), "part int, chunk long, kind int, n int, keys binary, counts binary")
    dealt = asked.repartitionById(ranges, F.col("part")).coalesce(partitions(chunks.sparkSession))
    return dealt.mapInArrow(answer, "chunk long, kind int, part int, n int, total binary, held binary")


def _written_clean(df: DataFrame, name: str) -> DataFrame:
    """Like ``written``, and the files of the shuffles behind the table go with the write's end: what chunks ask for is larger than the input."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return written(df, name)
    finally:
        conf.set(key, before)


def _with_answers(chunks: DataFrame, answers: DataFrame, *columns: str) -> DataFrame:
    """Chunks with the answers to them, by ranges of hashes."""
    counts = answers.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("part", "n", *columns))).alias("answers"))
    return chunks.join(counts, "chunk")


def _answers(row: dict, column: str) -> np.ndarray:
    return np.concatenate([_unpack(a[column], a["n"]) for a in row["answers"]]).astype(np.int64)


def count_classes(chunks: DataFrame, shared, classes: int) -> np.ndarray:
    """Class bigrams of the learned chunks: an array (held out, context, word) summed over all documents.

    Each task sums its documents and reports each context's row once, packed; the driver gets a row for each context.
    """
    width = classes + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * width * width, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                c = Chunk(row, *shared.value, classes)
                sums += np.bincount(((c.kind == _HELD) * width + c.row) * width + c.column, minlength=len(sums))
        grid = sums.reshape(2 * width, width)
        for k in np.flatnonzero(grid.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(grid[k].tobytes(), 1)], pa.binary())], ["context", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums the rows of a task by context; as many sums as contexts."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                row = np.frombuffer(zlib.decompress(packed), np.int64)
                sums[k] = sums[k] + row if k in sums else row
        for k, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(row.tobytes(), 1)], pa.binary())], ["context", "sums"])

    kind = "context long, sums binary"
    out = np.zeros((2 * width, width), np.int64)
    for k, packed in chunks.where(F.col("kind") != _NEW).mapInArrow(run, kind).repartition("context").mapInArrow(add, kind).collect():
        out[k] += np.frombuffer(zlib.decompress(packed), np.int64)
    return out.reshape(2, width, width)


def _em(p2: np.ndarray, p1: np.ndarray, p0: float, n: np.ndarray) -> np.ndarray:
    weights = np.full(3, 1 / 3)
    for _ in range(EM_STEPS):
        parts = np.stack([weights[0] * p2, weights[1] * p1, np.full(len(p2), weights[2] * p0)])
        weights = (parts / parts.sum(axis=0) * n).sum(axis=1)
        weights /= weights.sum()
    return weights


def _levels(p: np.ndarray) -> np.ndarray:
    """Half-octave levels of a probability, 0 for none."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.clip(LEVELS - 1 + np.round(2 * np.log2(np.maximum(p, 1e-300))), 1, LEVELS - 1), 0).astype(np.int64)


def _of_level(level: np.ndarray) -> np.ndarray:
    return np.where(level > 0, 2.0 ** ((level - (LEVELS - 1)) / 2), 0.0)


def learn(df: DataFrame, words: DataFrame) -> Model:
    """The model of the rows with ``learn``; ``words`` are the counts of their tokens, a written table."""
    spark = df.sparkSession
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = words.where(F.col("n") >= max(1, math.ceil(total * CLASS_SHARE))).toArrow()  # no more than 1 / CLASS_SHARE rows
    order = np.argsort(hashes := frequent["word"].to_numpy().astype(np.int64).view(np.uint64))
    common, counts = hashes[order], frequent["n"].to_numpy()[order]
    kinds = np.arange(1, len(common) + 1)
    classes = len(common) + 1
    shared = spark.sparkContext.broadcast((common, kinds))
    chunks = written(chunked(df), "chunks")
    bounded_batches(spark, rows=4000, size="8m")  # of chunks and answers from here on
    cells = count_classes(chunks, shared, classes)
    answers = _written_clean(answered(chunks, shared, classes, _ranges(spark, total)), "answers")
    both = cells.sum(axis=0)
    unigrams = np.bincount(kinds, counts, classes + 1)
    unigrams[0] = total - unigrams[1:].sum()
    unigrams[classes] = 0
    model = Model(common, kinds, both, unigrams, _bucket(both.sum(axis=1)), np.tile([0.0, 0.9, 0.1], (BUCKETS, 1)), int(total), int(distinct), (df, chunks, answers))
    model.weights = _fit_weights(chunks, answers, model, cells)
    return model


def _ranges(spark: SparkSession, total: int) -> int:
    return max(partitions(spark), total // RANGE_TOKENS)


def _fit_weights(chunks: DataFrame, answers: DataFrame, model: Model, cells: np.ndarray) -> np.ndarray:
    """EM over the held-out documents, whose own counts are taken out of the estimates."""
    kept, classes = cells[0], len(cells[0]) - 1
    kept_total = max(int(kept.sum()), 1)
    shared = chunks.sparkSession.sparkContext.broadcast((model.common, model.classes, kept))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        common, kinds, grid = shared.value
        for row in batch.to_pylist():
            c = Chunk(row, common, kinds, classes)
            c.keys()
            pair, context, word = c.counts(_answers(row, "total") - _answers(row, "held"), grid)
            given, alone = _levels(pair / np.maximum(context, 1)), _levels(word / kept_total)
            keys, n = np.unique((_bucket(context) * LEVELS + given) * LEVELS + alone, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n, pa.int64())], ["key", "n"])

    held = _with_answers(chunks.where(F.col("kind") == _HELD), answers.where(F.col("kind") == _HELD), "total", "held")
    rows = held.mapInArrow(each_batch(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()  # at most BUCKETS * LEVELS ** 2
    keys, n = rows["key"].to_numpy().astype(np.int64), rows["n"].to_numpy().astype(float)
    weights = model.weights.copy()
    done = np.unique(keys // LEVELS**2).tolist()
    for b in done:
        own = keys // LEVELS**2 == b
        weights[b] = _em(_of_level(keys[own] // LEVELS % LEVELS), _of_level(keys[own] % LEVELS), 1 / (model.distinct + 1), n[own])
    for b in set(range(BUCKETS)) - set(done) if done else ():  # a bucket without held-out events takes its neighbour's
        weights[b] = weights[min(done, key=lambda d: abs(d - b))]
    if not done:
        weights[:] = [0.0, 0.9, 0.1] if model.total else [0.0, 0.0, 1.0]
    weights[:, 2] = np.maximum(weights[:, 2], 1e-6)
    weights[0, 0] = 0  # nothing follows a context never learned
    return weights / weights.sum(axis=1, keepdims=True)


def score(df: DataFrame, words: DataFrame, model: Model) -> DataFrame:
    """Per row of ``df`` (doc_id, text): n_tokens, n_known, base_score and score, all summed where the chunk is.

    The documents that were learned from have their answers already; others ask among the learned chunks.
    """
    spark = df.sparkSession
    source, chunks, answers = model.learned
    classes = len(model.cells) - 1
    if df is not source:
        told = chunks.where(F.col("kind") != _NEW)
        chunks = written(chunked(df.select("doc_id", "text", F.lit(False).alias("learn"), F.lit(False).alias("held"))), "chunks")
        shared = spark.sparkContext.broadcast((model.common, model.classes))
        answers = _written_clean(answered(chunks.unionByName(told), shared, classes, _ranges(spark, model.total)), "answers")
    model_only = spark.sparkContext.broadcast(replace(model, learned=None))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        m: Model = model_only.value
        for row in batch.to_pylist():
            c = Chunk(row, m.common, m.classes, classes)
            c.keys()
            pair, context, word = c.counts(_answers(row, "total"), m.cells)
            a, b, rest = m.weights[_bucket(context)].T
            p = a * pair / np.maximum(context, 1) + b * word / max(m.total, 1) + rest / (m.distinct + 1)
            base = np.log10((word + 0.1) / (m.total + 0.1 * (m.distinct + 1)))
            starts = np.cumsum(c.sizes) - c.sizes  # each document has a token at least
            columns = [
                pa.array(c.ids, pa.int64()),
                pa.array(c.sizes),
                pa.array(np.add.reduceat((word > 0).astype(np.int64), starts)),
                pa.array(np.add.reduceat(base, starts)),
                pa.array(np.add.reduceat(np.log10(p), starts)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return _with_answers(chunks, answers, "total").mapInArrow(each_batch(run), "doc_id long, n_tokens long, n_known long, base_score double, score double")


def with_folds(documents: DataFrame) -> DataFrame:
    """doc_id, text, ``learn`` (not in fold 0 of 10) and ``held`` (learned, and in fold 1: the weights' held-out part)."""
    part = fold("doc_id", 10)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), (part != 0).alias("learn"), (part == 1).alias("held"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the model of those outside fold 0."""
    bounded_batches(spark, rows=4000, size="16m")
    documents = with_folds(table(spark, sf_dir, "documents"))
    words = _written_clean(count_words(documents), "words")
    model = learn(documents, words)
    scores = score(documents, words, model)
    return scores.select(
        "doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score"
    )
