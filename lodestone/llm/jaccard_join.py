"""Exact groups of near-duplicates: a Jaccard join in metric space.

Documents are sets of word shingles; two are linked if their Jaccard similarity is
``PERCENT`` or more, that is, if their distance 1 - J is within a radius e.

Pivots and regions.  The pivots are the one-shingle sets.  A document x lies at distance
1 - 1/|x| from the pivots of its own shingles and at distance 1 from all others, so its nearest
pivots are its own shingles and an order of shingles settles the ties: the first one gives its
Voronoi region.  A document within e of x shares at least PERCENT of x's shingles, hence its
region can only be among the first |x| - ceil(PERCENT |x|) + 1 shingles of x: the window to which
x is replicated.  Linked documents therefore share a region, in any order of the shingles that is
the same for all of them.

The order puts shingles that more than ``REGION`` documents have in their windows, or right behind
them, last; among the others and among those the hash decides.  Regions of up to ``REGION``
documents join directly: a pair is a candidate if its sizes and the number of regions that it
shares leave room for the similarity.  Candidates are compared set by set, first each document
with the neighbour that has the most candidates, then those whose ends are in different groups.

Larger regions recur: their documents are dealt anew among themselves, over an order by how
many of them have a shingle, the rarest first, and a shingle of one of them alone is nobody's
pivot.  What still meets in a region has most in common.  There documents are pivots: the centre
is the member that has the fewest shingles rarer than the region's own, and the others are compared
with it and join its group.  With whatever has the region's shingle as the first in common, a member of n
shingles, r of them rarer, shares n - r at most; by that bound on the distance, members too far off leave
the region and pairs too far apart are not compared.  A region whose members are one group is done.
Further centres, from outside of the region's main group, follow in rounds, more in each, so that
the rounds grow with the logarithm of a region's groups; each is compared with members of other groups only.

Groups are found, not all pairs: a link is looked for until its ends are in one group.

Nothing is held of a text but its set's fingerprint; sets are made again out of the texts in each
pass, which takes less than to write and shuffle them.

Defined results: words are runs of other than white space, A-Z lower-cased; a document of
fewer words than a shingle has its whole sequence as the one shingle; without words (null,
empty, blank) it has no shingles, is linked with nothing and is a group of its own.  Equal sets
are one node, so copies cost nothing.  Repeated rows stay one by one; a null doc_id is never a
group's id unless the group has no other.  Columns other than doc_id and text are left out by ``groups``
and kept, whatever their names, by ``one_of_each``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import Bitmap, Scratch, binary_slices, bounded_batches, each_batch, kept, table, written
from ._text import Words, byte_chunks, mix64, ragged
from .components import components

#: Members up to which a region joins directly.
REGION = 64
#: Centres of a large region in the second round; the first has one, each later one four times as many.
CENTRES = 32

def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct shingle hashes of each text, one after the other, and the size of each set."""
    words = Words(data, offsets, alnum=False)
    h, counts = words.hashes, np.diff(words.bounds)
    whole = np.maximum(counts - k + 1, 0)
    first = ragged(words.bounds[:-1], whole)
    shingle = np.full(len(first), k, np.uint64)
    for j in range(k):
        shingle = mix64(shingle * np.uint64(3) + h[first + j]) if len(first) else shingle
    doc = np.repeat(np.arange(len(counts)), whole)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        one = counts[short].astype(np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            one[has] = mix64(one[has] * np.uint64(3) + h[words.bounds[short[has]] + j])
        shingle, doc = np.concatenate((shingle, one)), np.concatenate((doc, short))
    order = np.lexsort((shingle, doc))
    shingle, doc = shingle[order], doc[order]
    if len(doc):
        new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])))
        shingle, doc = shingle[new], doc[new]
    return shingle, np.bincount(doc, minlength=len(counts))


def _per_set(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    ends = np.cumsum(sizes)
    return (sums[ends] - sums[ends - sizes]).view(np.int64)


def _fingerprints(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two integers."""
    return _per_set(mix64(sets ^ np.uint64(0x6A09E667F3BCC908)), sizes), _per_set(mix64(sets + np.uint64(0xBB67AE8584CAA73B)), sizes)


def _window(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (percent * n + 99) // 100 + 1


def _keys(fp1: np.ndarray, fp2: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """A set's node: half of its fingerprint, or both halves mixed where sets share the first half (``shared``)."""
    return np.where(np.isin(fp1, shared), fp1 ^ fp2, fp1) if len(shared) else fp1


def _prints(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, the size of its set and the set's fingerprint."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, end, data, offsets in byte_chunks(batch.column("text")):
            sets, sizes = shingle_sets(data, offsets, k)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.array(sizes, pa.int64()), *map(pa.array, _fingerprints(sets, sizes))], ["doc_id", "n", "fp1", "fp2"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each_batch(run), "doc_id long, n long, fp1 long, fp2 long")


class _Sets:
    """The sets of some documents, made out of their texts in every pass.

    Which texts are read is told by a bitmap of their ids, of fixed size: what it lets through needlessly are
    documents whose set is a node all the same, so that a node may come twice.
    """

    def __init__(self, documents: DataFrame, first_docs: DataFrame, k: int, shared: np.ndarray, scratch: Scratch) -> None:
        self.texts = documents.select(F.xxhash64(F.col("doc_id").cast("long")).alias("h"), "text")
        self.wanted = scratch.broadcast(Bitmap.of(scratch.few(first_docs.select(F.xxhash64("first_doc").alias("h")), "wanted"), "h"))
        self.k, self.shared = k, shared

    def through(self, f: Callable[[np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
        """What ``f`` makes of (sets one after the other, their sizes, their nodes), chunk by chunk."""
        wanted, k, shared = self.wanted, self.k, self.shared

        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            some = batch.filter(pa.array(wanted.value.has(np.asarray(batch.column("h"), np.int64))))
            for _, _, data, offsets in byte_chunks(some.column("text")) if some.num_rows else ():
                sets, sizes = shingle_sets(data, offsets, k)
                nodes, one = np.unique(_keys(*_fingerprints(sets, sizes), shared), return_index=True)  # copies in a chunk go once
                nodes, one = nodes[sizes[one] > 0], one[sizes[one] > 0]
                yield f(sets[ragged((np.cumsum(sizes) - sizes)[one], sizes[one])], sizes[one], nodes)

        return self.texts.mapInArrow(each_batch(run), schema)


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a binary column one after the other, and how many each row has."""
    column = column.cast(pa.large_binary())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), np.uint64), np.diff(offsets) // 8


_ROWS = "pivot long, node long, n long, rank long"


def _window_rows(sets: np.ndarray, sizes: np.ndarray, nodes: np.ndarray, levels: list[Bitmap], percent: int, only: Bitmap | None = None) -> pa.RecordBatch:
    """A row for each shingle of each set's window, in the order (how many of ``levels`` have it, hash), with its rank in
    the set; with ``only`` just the rows of pivots that may be in it."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.arange(len(sets)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    take = rank < np.repeat(_window(sizes, percent), sizes)
    if levels:
        late = np.zeros(len(sets), np.int64)
        for level in levels:
            late += level.has(sets)
        order = np.argsort(doc * (len(levels) + 1) + late, kind="stable")
        sets, doc = sets[order], doc[order]
    if only is not None:
        take &= only.has(sets)
    of = doc[take]
    return pa.RecordBatch.from_arrays([pa.array(sets[take].view(np.int64)), pa.array(nodes[of]), pa.array(sizes[of].astype(np.int64)), pa.array(rank[take].astype(np.int64))], ["pivot", "node", "n", "rank"])


def _counted(values: np.ndarray) -> pa.RecordBatch:
    found, counts = np.unique(values, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(counts.astype(np.int64))], ["pivot", "nodes"])


def _frequent(sets: _Sets, percent: int) -> DataFrame:
    """(pivot) of shingles that more than REGION documents have among the first ones, up to half a window behind it."""

    def run(flat: np.ndarray, sizes: np.ndarray, _: np.ndarray) -> pa.RecordBatch:
        rank = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return _counted(flat[rank < np.repeat(3 * _window(sizes, percent) // 2, sizes)])

    return sets.through(run, "pivot long, nodes long").groupBy("pivot").agg(F.sum("nodes").alias("nodes")).where(F.col("nodes") > REGION).select("pivot")


def _regions(rows: DataFrame) -> DataFrame:
    """(pivot, members, large) of regions of two rows or more; no more than REGION + 1 are gathered, and ``large`` tells that there are."""
    rank = F.row_number().over(Window.partitionBy("pivot").orderBy("node"))
    few = rows.select("pivot", "node", "n").withColumn("place", rank).where(F.col("place") <= REGION + 1)
    gathered = few.groupBy("pivot").agg(F.collect_set(F.struct("node", "n")).alias("members"), F.max("place").alias("most"))
    return gathered.where(F.size("members") > 1).select("pivot", "members", (F.col("most") > REGION).alias("large"))


def _near_sizes(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _room(na: Column, nb: Column, common: Column, percent: int) -> Column:
    """Whether ``common`` shingles are enough for a link of two sets of na and nb."""
    return common * (100 + percent) >= (na + nb) * percent


def _direct_pairs(regions: DataFrame, percent: int) -> DataFrame:
    """Pairs of small regions that share enough of them: (a, na, b, nb), a < b.

    Beyond those in both windows, they can share no more than what is behind the window that ends first.
    """
    one = regions.where("not large").select(F.explode("members").alias("x"), "members")
    near = F.filter("members", lambda m: (m["node"] > F.col("x.node")) & _near_sizes(m["n"], F.col("x.n"), percent))
    pairs = one.select("x", F.explode(near).alias("y")).select(F.col("x.node").alias("a"), F.col("x.n").alias("na"), F.col("y.node").alias("b"), F.col("y.n").alias("nb"))
    shared = pairs.groupBy("a", "na", "b", "nb").agg(F.count("*").alias("shared"))
    behind = F.expr(f"({percent} * greatest(na, nb) + 99) div 100 - 1")
    return shared.where(_room(F.col("na"), F.col("nb"), F.col("shared") + behind, percent)).drop("shared")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of those pairs (a, na, b, nb) whose sets are similar enough."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keep, last, x = [], None, np.zeros(0, np.uint64)
        for a, sa, sb in zip(batch.column("a").to_pylist(), batch.column("sa"), batch.column("sb"), strict=True):
            if a != last:
                last, x = a, np.frombuffer(sa.as_buffer(), np.uint64)
            y = np.frombuffer(sb.as_buffer(), np.uint64)
            small, great = (x, y) if len(x) < len(y) else (y, x)
            at = great.searchsorted(small)
            at[at == len(great)] = 0
            common = int((great[at] == small).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.select("a", "b").join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    return both.mapInArrow(each_batch(run), "a long, b long")


def _whole_sets(sets: _Sets, nodes: DataFrame) -> DataFrame:
    """(node, set) of these nodes."""

    def run(flat: np.ndarray, sizes: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(node), binary_slices(flat.view(np.uint8), sizes * 8).cast(pa.binary())], ["node", "set"])

    return sets.through(run, "node long, set binary").join(nodes.select("node"), "node", "left_semi").groupBy("node").agg(F.first("set").alias("set"))


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends are in different groups."""
    named = pairs.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
    return named.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select(pairs.columns)


def _candidate_links(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links that connect what all links among these candidates would: of each document with its neighbour of most
    candidates first, then of those whose ends are still in different groups."""
    ends = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b"))
    degree = scratch.few(ends.groupBy("node").agg(F.count("*").alias("degree")), "degrees")
    ranked = pairs.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    up = F.struct("db", "b") > F.struct("da", "a")
    climb = ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("low"), F.when(up, F.struct(F.col("db").alias("d"), F.col("b").alias("hub"))).otherwise(F.struct(F.col("da").alias("d"), F.col("a").alias("hub"))).alias("up"))
    first = climb.groupBy("low").agg(F.max("up.hub").alias("any"), F.max("up").alias("up")).select(F.least("low", "up.hub").alias("a"), F.greatest("low", "up.hub").alias("b"))
    first = scratch.few(first, "first")
    links = scratch.gathered(_links(first, sets, percent), "links")
    rest = pairs.join(first, ["a", "b"], "left_anti")
    rest = scratch.few(_between(rest, components(links, scratch)), "rest")
    return scratch.gathered(links.unionAll(_links(rest, sets, percent)), "links")


def _recur(sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(pivot, node, n, rank) of these sets, dealt among themselves over the rarest shingles first, by powers of two."""

    def count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield _counted(_flat(batch.column("set"))[0])

    counts = sets.mapInArrow(each_batch(count), "pivot long, nodes long").groupBy("pivot").agg(F.sum("nodes").alias("nodes")).where("nodes > 1")
    counts = scratch.gathered(counts, "counts")
    most = counts.agg(F.max("nodes")).first()[0] or 2
    levels = scratch.broadcast([Bitmap.of(counts.where(F.col("nodes") >= 1 << j), "pivot") for j in range(1, most.bit_length())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        flat, sizes = _flat(batch.column("set"))
        yield _window_rows(flat, sizes, np.asarray(batch.column("node"), np.int64), levels.value, percent, levels.value[0])

    return scratch.written(sets.mapInArrow(each_batch(run), _ROWS), "rows")


def _centre_rounds(rows: DataFrame, sets: DataFrame, links: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, component) by ``links`` and by those among the members of a region."""
    near = _near_sizes(F.col("x.n"), F.col("y.n"), percent)
    left = F.least(F.col("x.n") - F.col("x.rank"), F.col("y.n") - F.col("y.rank"))
    feasible = (F.col("x.label") != F.col("y.label")) & near & _room(F.col("x.n"), F.col("y.n"), left, percent)
    partner = F.expr(f"greatest(least, ({percent} * n + 99) div 100)")
    labels, centres = components(links, scratch), 1
    while True:
        least = rows.groupBy("pivot").agg(F.min("n").alias("least"))
        near_enough = rows.join(least, "pivot").where(_room(F.col("n"), partner, F.col("n") - F.col("rank"), percent)).drop("least")
        named = near_enough.join(labels, "node", "left").select("pivot", "node", "n", "rank", F.coalesce("component", "node").alias("label"))
        named = scratch.few(named, "named")
        sizes = named.groupBy("pivot", "label").agg(F.count("*").alias("size"))
        per = sizes.groupBy("pivot").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.max("size").alias("most"), F.count("*").alias("groups"))
        per = per.where("groups > 1").select("pivot", "main", "most")
        named = scratch.few(named.join(per, "pivot").withColumn("out", (F.col("label") != F.col("main")) | (F.col("most") == 1)).drop("main", "most"), "open")
        if named.isEmpty():
            return labels
        place = F.row_number().over(Window.partitionBy("pivot").orderBy("rank", "node"))
        chosen = named.where("out").withColumn("place", place).where(F.col("place") <= centres)
        chosen = scratch.few(chosen.select("pivot", "node", "n", "rank", "label"), "centres")
        x, y = chosen.alias("x"), named.alias("y")
        pairs = x.join(y, (F.col("x.pivot") == F.col("y.pivot")) & feasible).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        found = scratch.gathered(_links(scratch.gathered(pairs, "pairs"), sets, percent), "found")
        if not found.isEmpty():
            links = scratch.few(links.unionAll(found), "links")
            labels = components(links, scratch)
        rows = named.select("pivot", "node", "n", "rank").join(chosen.select("pivot", "node"), ["pivot", "node"], "left_anti")
        centres = max(CENTRES, centres * 4)


def _labels(documents: DataFrame, nodes: DataFrame, shared: np.ndarray, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """(node, component) of all nodes that have a link."""
    sets = _Sets(documents, nodes, k, shared, scratch)
    late = scratch.gathered(_frequent(sets, percent), "late")
    levels = [] if late.isEmpty() else [Bitmap.of(late, "pivot")]
    order = scratch.broadcast(levels)
    rows = sets.through(lambda flat, sizes, node: _window_rows(flat, sizes, node, order.value, percent), _ROWS)
    regions = scratch.written(_regions(rows), "regions")
    pairs = scratch.gathered(_direct_pairs(regions, percent), "pairs")
    large = regions.where("large").select("pivot")
    members = None
    if not large.isEmpty():
        only = scratch.broadcast(Bitmap.of(large, "pivot"))
        rows = sets.through(lambda flat, sizes, node: _window_rows(flat, sizes, node, order.value, percent, only.value), _ROWS)
        members = scratch.gathered(rows.join(large, "pivot", "left_semi").select("node").distinct(), "members")
    needed = pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b"))
    needed = scratch.few((needed if members is None else needed.unionAll(members)).distinct(), "needed")
    some = nodes.join(needed, "node", "left_semi")
    whole = scratch.written(_whole_sets(_Sets(documents, some, k, shared, scratch), needed), "sets")
    links = _candidate_links(pairs, whole, percent, scratch)
    if members is not None:
        again = scratch.written(whole.join(members, "node", "left_semi"), "again")
        return _centre_rounds(_recur(again, percent, scratch), again, links, percent, scratch)
    return components(links, scratch)


def groups(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """For every row: doc_id, n_shingles, component_id (the least doc_id of its group), group (a number of the group, null
    without shingles) and the set's fingerprint."""
    spark = documents.sparkSession
    bounded_batches(spark)
    with Scratch(spark) as scratch:
        prints = scratch.written(_prints(documents, k), "prints")
        scratch.sized_for(prints.count())
        nodes = prints.where("n > 0").groupBy("fp1", "fp2").agg(F.min("doc_id").alias("first_doc"), F.first("n").alias("n"))
        nodes = scratch.few(nodes, "nodes")
        twice = nodes.groupBy("fp1").agg(F.count("*").alias("sets")).where("sets > 1")  # n^2 / 2^65 of them are to be expected
        shared = np.array(sorted(r["fp1"] for r in twice.collect()), np.int64)
        node = F.when(F.col("fp1").isin(shared.tolist()), F.col("fp1").bitwiseXOR(F.col("fp2"))).otherwise(F.col("fp1")) if len(shared) else F.col("fp1")
        nodes = nodes.withColumn("node", node)
        labels = _labels(documents, nodes, shared, k, percent, scratch)
        named = nodes.select("node", "fp1", "fp2", "first_doc").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        least = named.groupBy("component").agg(F.min("first_doc").alias("component_id"))
        named = named.join(least, "component").select("fp1", "fp2", "component_id", F.col("component").alias("group"))
        slim = prints.select("doc_id", F.col("n").alias("n_shingles"), "fp1", "fp2")
        grouped = slim.join(named, ["fp1", "fp2"], "left")
        return kept(grouped.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "group", "fp1", "fp2"), "groups")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents by four-word shingles at a similarity of 0.85."""
    return groups(table(spark, sf_dir, "documents").select("doc_id", "text"), k=4, percent=85).select("doc_id", "n_shingles", "component_id")


#: All pairs that share a shingle.
OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[a : a + 3], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS a FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 85 * (p.n + q.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.least AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a, min(b) AS least FROM reach GROUP BY a) r ON r.a = d.doc_id
"""


def one_of_each(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without near-duplicates: of each group the one of the least doc_id stays.

    Rows of equal id and equal text count as one document; a null id stays only if its group has no other.
    Only texts whose id may be among those that go are shuffled.
    """
    spark = documents.sparkSession
    found = groups(documents, k, percent)
    gone = written(found.where("not (doc_id <=> component_id)").select("doc_id").distinct(), "gone")
    hashed = F.xxhash64(documents["doc_id"].cast("long"))
    maybe = _in_bitmap(spark, Bitmap.of(gone.select(F.xxhash64("doc_id").alias("h")), "h"))
    few = documents.where(maybe(hashed))
    kept = documents.where(~maybe(hashed)).unionByName(few.join(gone, few["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti"))
    # rows of one id can't be told apart by it; they are rare and go by their sets
    twice = found.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    twice = written(twice, "twice")
    single = kept.join(twice, kept["doc_id"].eqNullSafe(twice["doc_id"]), "left_anti")
    rows = _with_prints(documents.join(twice, documents["doc_id"].eqNullSafe(twice["doc_id"]), "left_semi"), k).alias("r")
    known = found.where("doc_id <=> component_id").select("doc_id", "fp1", "fp2", "group").distinct().alias("g")
    same = F.col("r.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.col("__fp1") == F.col("g.fp1")) & (F.col("__fp2") == F.col("g.fp2"))
    rows = rows.join(known, same).select("r.*", F.col("g.group").alias("__group"))
    first = rows.where("__group is not null").groupBy("__group").agg(F.min(F.struct("__tie", *documents.columns)).alias("one")).select("one.*").select(documents.columns)
    return single.unionByName(first).unionByName(rows.where("__group is null").select(documents.columns))


def _in_bitmap(spark: SparkSession, bitmap: Bitmap) -> Callable[[Column], Column]:
    """Whether a hash may be in the bitmap; only hashes go to Python, the rows stay where they are."""
    shared = spark.sparkContext.broadcast(bitmap)
    return F.arrow_udf(lambda h: pa.array(shared.value.has(np.asarray(h, np.int64))), "boolean")


def _with_prints(documents: DataFrame, k: int) -> DataFrame:
    """Adds the fingerprint of each text's set and a hash of the text."""
    schema = T.StructType([*documents.schema.fields, T.StructField("__fp1", T.LongType()), T.StructField("__fp2", T.LongType())])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row, end, data, offsets in byte_chunks(batch.column(batch.schema.get_field_index("text"))):
            prints = _fingerprints(*shingle_sets(data, offsets, k))
            part = batch.slice(row, end - row)
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, prints)], schema.names)

    return documents.mapInArrow(each_batch(run), schema).withColumn("__tie", F.xxhash64(F.coalesce("text", F.lit(""))))
