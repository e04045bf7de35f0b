"""Benchmark decontamination with suffix arrays of the training text.

The training text is cut into shards of whole documents.  Each shard gets a suffix
array over its words, every suffix of every benchmark text is searched in it by
bisection, and the matches are extended to the longest verbatim one.  The search goes by hashes of
words; the words of a match are then compared letter by letter.  Documents in
which a benchmark window occurs are dropped.

The suffix array is sparse: a suffix is in it only if its first two words follow one
another in some benchmark text too, as no other suffix can begin a window of two words
or more.  (If a benchmark text is a single word, all suffixes are in it.)  Suffixes are
ordered by the hashes of their first 16 words; windows and matches that are longer are
compared word by word, so no depth is cut off.

The benchmark is the fixed side.  It is read in blocks of bounded size, each broadcast
on its own: a larger benchmark means more passes, between which the documents are written with what was found so far, not more memory.

Defined results: words are maximal runs of digits, letters and bytes of other scripts,
A-Z lower-cased; a window is ``window`` consecutive words of an item, an item of fewer
words is one window, one without words never occurs.  Null texts have no words.  Rows
of a document table stay one by one, repeated ones too; items with the same item_id count
as one.  The longest match is that of matches of a whole window or more, 0 without any.  Other columns
pass through; a column of an output's name is replaced.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import bounded_batches, each_batch, ragged_list, table, written
from ._text import Words, byte_chunks, mix64, ragged

#: UTF-8 bytes of benchmark texts in one broadcast; a longer text makes a block of its own.
BLOCK_BYTES = 8 << 20
#: Text of one shard, about.
SHARD_BYTES = 1 << 20
_END = np.uint64(0)


class Benchmark:
    """Words, windows and all suffixes of a block of items."""

    def __init__(self, items: list[tuple[object, str | None]], window: int) -> None:
        texts = pa.array([t or "" for _, t in items], pa.large_string())
        hashes, lengths = [], []
        self.spelled: dict[int, bytes] = {}
        for _, _, data, offsets in byte_chunks(texts):
            words = Words(data, offsets, alnum=True)
            hashes.append(words.hashes)
            for h, word in zip(words.hashes.tolist(), words.spelled(np.arange(len(words.hashes))), strict=True):
                if self.spelled.setdefault(h, word) != word:
                    raise ValueError(f"two words of the benchmark have the same hash: {word!r}")
            lengths.append(np.diff(words.bounds))
        self.names = ["" if i is None else str(i) for i, _ in items]
        self.words = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        lengths = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
        self.item = np.repeat(np.arange(len(items)), lengths)
        place = np.arange(len(self.words)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.left = np.repeat(lengths, lengths) - place  # words from here to the end of the item
        self.need = np.minimum(np.repeat(lengths, lengths), window)  # words of a window of this item
        #: Suffixes of which the first words are a window.
        self.suffixes = np.flatnonzero(self.left >= self.need)
        self.least = int(lengths[lengths > 0].min()) if (lengths > 0).any() else 0
        follows = self.left > 1
        pair = _pairs(self.words)
        self.pairs = np.unique(pair[follows[: len(pair)]])


def _pairs(words: np.ndarray) -> np.ndarray:
    return mix64(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else np.zeros(0, np.uint64)


class ShardIndex:
    """Sparse suffix array over the words of some documents."""

    def __init__(self, words: np.ndarray, left: np.ndarray, begin: np.ndarray) -> None:
        self.words, self.left = words, left
        depth = min(16, int(left[begin].max())) if len(begin) else 0
        keys = _window_keys(words, left, begin, depth)
        order = np.lexsort(keys[::-1]) if len(keys) else np.zeros(0, np.int64)
        self.array = begin[order]
        self.keys = [k[order] for k in keys]

    def scattered(self, at: np.ndarray, query: np.ndarray, depth: int) -> np.ndarray:
        """Of these suffixes, those that go on like the query, compared word by word."""
        for d in range(depth, len(query)):
            at = at[(self.left[at] > d) & (self.words[np.minimum(at + d, len(self.words) - 1)] == query[d])]
        return at


def _window_keys(words: np.ndarray, left: np.ndarray, begin: np.ndarray, depth: int) -> list[np.ndarray]:
    out = []
    for d in range(depth):
        key = words[np.minimum(begin + d, len(words) - 1)].copy()
        key[left[begin] <= d] = _END
        out.append(key)
    return out


def matches(words: np.ndarray, left: np.ndarray, bench: Benchmark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All places where a suffix of an item begins with a whole window: place, item suffix and the longest common run of words."""
    none = np.zeros(0, np.int64)
    if not len(words) or not len(bench.suffixes):
        return none, none, none
    if bench.least > 1:
        pair = _pairs(words)
        at = np.searchsorted(bench.pairs, pair)
        begin = np.flatnonzero((bench.pairs[np.minimum(at, len(bench.pairs) - 1)] == pair) & (left[:-1] > 1)) if len(bench.pairs) else none
    else:
        begin = np.arange(len(words))
    if not len(begin):
        return none, none, none
    index = ShardIndex(words, left, begin)
    lo, hi = np.zeros(len(bench.suffixes), np.int64), np.full(len(bench.suffixes), len(index.array), np.int64)
    need = bench.need[bench.suffixes]
    deep: list[tuple[int, np.ndarray]] = []
    for depth in range(int(need.max())):  # all suffixes are bisected together, one word deeper each time
        live = np.flatnonzero((need > depth) & (lo < hi))
        if not len(live):
            break
        word = bench.words[bench.suffixes[live] + depth]
        if depth < len(index.keys):
            lo[live], hi[live] = _bisect(index.keys[depth], lo[live], hi[live], word)
        else:
            for k in live.tolist():
                query = bench.words[bench.suffixes[k] : bench.suffixes[k] + need[k]]
                deep.append((k, index.scattered(index.array[lo[k] : hi[k]], query, depth)))
                lo[k] = hi[k]
            break
    sizes = hi - lo
    place = index.array[ragged(lo, sizes)]
    suffix = np.repeat(bench.suffixes, sizes)
    if deep:
        place = np.concatenate((place, *(p for _, p in deep)))
        suffix = np.concatenate((suffix, *(np.full(len(p), bench.suffixes[k]) for k, p in deep)))
    length = bench.need[suffix].copy()
    live = np.arange(len(place))
    while len(live):  # extended to the longest match
        live = live[(left[place[live]] > length[live]) & (bench.left[suffix[live]] > length[live])]
        live = live[words[place[live] + length[live]] == bench.words[suffix[live] + length[live]]]
        length[live] += 1
    return place, suffix, length


def _bisect(key: np.ndarray, lo: np.ndarray, hi: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each interval in which the key equals the word; keys ascend within an interval."""
    out = []
    for right in (False, True):
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            at = key[np.minimum(mid, len(key) - 1)]
            go = open_ & ((at <= word) if right else (at < word))
            a[go] = mid[go] + 1
            b[open_ & ~go] = mid[open_ & ~go]
        out.append(a)
    return out[0], out[1]


def benchmark_blocks(benchmark: DataFrame, window: int, item_id: str = "item_id", text: str = "text") -> Iterator[Benchmark]:
    """The items in blocks of bounded size; one block at a time reaches the driver."""
    block: list[tuple[object, str | None]] = []
    size = 0
    for i, t in benchmark.select(item_id, text).distinct().coalesce(1).toLocalIterator():
        if block and size + len(t or "") * 4 > BLOCK_BYTES:
            yield Benchmark(block, window)
            block, size = [], 0
        block.append((i, t))
        size += len(t or "") * 4
    yield Benchmark(block, window)


def mark(df: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text", keep_text: bool = False, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Adds to each document ``n_words``, ``hit_starts`` and ``hit_lengths`` (words inside occurrences, as disjoint runs),
    ``items`` (ids as strings, sorted) and ``longest`` (words of the longest verbatim match)."""
    spark = df.sparkSession
    bounded_batches(df.sparkSession)
    added = ["n_words", "hit_starts", "hit_lengths", "items", "longest"]
    carried = [c for c in df.columns if c not in added]
    kinds = [T.LongType(), T.ArrayType(T.IntegerType()), T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType()), T.IntegerType()]
    blocks = benchmark_blocks(benchmark, window, item_id, item_text)
    block, before = next(blocks), False
    while block is not None:
        following = next(blocks, None)
        columns = [c for c in carried if c != text or keep_text or following is not None]
        schema = T.StructType([df.schema[c] for c in columns] + [T.StructField(n, t) for n, t in zip(added, kinds, strict=True)])
        shared = spark.sparkContext.broadcast(block)
        df = df.mapInArrow(each_batch(_marker(shared, text, columns, added, before)), schema)
        if following is not None:
            df = written(df, "marked")
            shared.destroy()
        block, before = following, True
    return df


def _marker(shared, text: str, columns: list[str], added: list[str], before: bool):
    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = shared.value
        named = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for row, end, data, offsets in byte_chunks(named[text], SHARD_BYTES):
            found = Words(data, offsets, alnum=True)
            counts = np.diff(found.bounds)
            left = np.repeat(found.bounds[1:], counts) - np.arange(len(found.hashes))
            while True:
                place, suffix, length = matches(found.hashes, left, bench)
                cover = np.bincount(place, minlength=len(left) + 1) - np.bincount(place + length, minlength=len(left) + 1)
                inside = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
                wrong = [i for i, h, word in zip(inside.tolist(), found.hashes[inside].tolist(), found.spelled(inside), strict=True) if bench.spelled[h] != word]
                if not wrong:
                    break
                found.hashes[wrong] = _END  # another word of equal hash: of no benchmark word's
            doc = np.searchsorted(found.bounds, place, "right") - 1
            # words inside an occurrence: those of a whole run that is common to item and document
            hit = np.zeros(len(left) + 1, bool)
            hit[inside] = True
            longest = np.zeros(end - row, np.int32)
            np.maximum.at(longest, doc, length.astype(np.int32))
            items: list[list[str]] = [[] for _ in range(end - row)]
            for code in np.unique(doc * len(bench.names) + bench.item[suffix]).tolist() if len(place) else ():
                items[code // len(bench.names)].append(bench.names[code % len(bench.names)])
            if before:
                earlier = {n: named[n].slice(row, end - row) for n in added}
                hit[: len(found.hashes)] |= _runs_to_mask(earlier["hit_starts"], earlier["hit_lengths"], found.bounds)
                items = [a + b for a, b in zip(items, earlier["items"].to_pylist(), strict=True)]
                longest = np.maximum(longest, np.asarray(earlier["longest"]))
            starts, lengths, per_doc = _mask_to_runs(hit[: len(found.hashes)], found.bounds)
            yield pa.RecordBatch.from_arrays(
                [
                    *(named[c].slice(row, end - row) for c in columns),
                    pa.array(counts, pa.int64()),
                    ragged_list(starts, per_doc, pa.int32()),
                    ragged_list(lengths, per_doc, pa.int32()),
                    pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())),
                    pa.array(longest, pa.int32()),
                ],
                [*columns, *added],
            )

    return run


def _mask_to_runs(hit: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.zeros(len(hit) + 1, bool)
    first[bounds] = True
    begin = hit.copy()
    stop = np.zeros(len(hit) + 1, bool)
    if len(hit):
        begin[1:] &= ~hit[:-1] | first[1 : len(hit)]
        stop[1:] = hit
        stop[1 : len(hit)] &= ~hit[1:] | first[1 : len(hit)]
    begin, stop = np.flatnonzero(begin), np.flatnonzero(stop)
    doc = np.searchsorted(bounds, begin, "right") - 1
    return begin - bounds[doc], stop - begin, np.bincount(doc, minlength=len(bounds) - 1)


def _runs_to_mask(starts: pa.Array, lengths: pa.Array, bounds: np.ndarray) -> np.ndarray:
    per_doc = np.asarray(starts.value_lengths(), np.int64)
    at = np.asarray(starts.flatten(), np.int64) + np.repeat(bounds[:-1], per_doc)
    mask = np.zeros(int(bounds[-1]), bool)
    mask[ragged(at, np.asarray(lengths.flatten(), np.int64))] = True
    return mask


def decontaminate(df: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """The documents in which no benchmark window occurs, with their own columns."""
    inner = {c: f"__{i}" for i, c in enumerate(df.columns)}  # names of the marks can't clash with the documents' own
    marked = mark(df.withColumnsRenamed(inner), benchmark, window, text=inner[text], keep_text=True)
    clean = marked.where(F.size("hit_starts") == 0).select(*inner.values())
    return clean.withColumnsRenamed({v: k for k, v in inner.items()})


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of all documents against the whole benchmark table."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark(documents, table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id",
        "n_words",
        F.aggregate("hit_lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_starts") > 0).alias("contaminated"),
    )


OP6_SQL = r"""
WITH words AS (
  SELECT 0 AS side, doc_id::VARCHAR AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT 1, item_id::VARCHAR, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), windows AS (
  SELECT DISTINCT id AS item, k, array_to_string(w[a : a + k - 1], ' ') AS said
  FROM (SELECT id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS a FROM words WHERE side = 1 AND len(w) > 0)
), places AS (
  SELECT id, a, k, array_to_string(w[a : a + k - 1], ' ') AS said
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS a FROM words, (SELECT DISTINCT k FROM windows) WHERE side = 0 AND len(w) >= k)
), found AS (
  SELECT id, a, p.k, item FROM places p JOIN windows v ON p.said = v.said AND p.k = v.k
), hits AS (
  SELECT id, count(DISTINCT place) AS n FROM (SELECT id, unnest(range(a, a + k)) AS place FROM found) GROUP BY id
), items AS (
  SELECT id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT id, item FROM found) GROUP BY id
)
SELECT d.doc_id, len(w.w)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(i.n, 0)::BIGINT AS n_items, coalesce(i.digest, sha256('')) AS items_sha256, h.n IS NOT NULL AS contaminated
FROM documents d JOIN words w ON w.side = 0 AND w.id = d.doc_id::VARCHAR LEFT JOIN hits h ON h.id = w.id LEFT JOIN items i ON i.id = w.id
"""
