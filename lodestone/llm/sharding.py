"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has 2**63 places.  Every shard stands at ``VNODES`` of them; a row's place is a
hash of its id and text, and the first node clockwise owns it.  A shard takes no more than its
share of the rows: what overflows goes on clockwise to the next node whose shard has
room.  The shares differ by one row at most and sum up to all rows, so balance is
guaranteed; a row that its owner has room for never moves for the sake of others.

Everything runs on DataFrame functions.  Equal rows (id, text digest, size) are counted
first, so that a row that fills a third of the table is one key.  The ring is cut into
cells, more of them the more rows there are; nodes stand at cell borders.  The driver gets
the number of rows of each cell (``CELL_ROWS`` rows or more for each beyond the first
65,536 cells), lets them flow through the ring, and hands back for each cell which of
its rows go to which shard.  A row's rank in its cell then tells its shard and slot.

Defined results: a null text has no bytes and crc 0; a null id is a key like others; equal
rows are told apart by their slots alone; an empty table gives no rows.  Other columns are
left out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import partitions, table, utf8_crc32, written

VNODES = 64
#: Rows of a cell, about, where the table is large.
CELL_ROWS = 1 << 20
_CELL_BITS = 16
#: Copies of one key that a task writes out at once.
_COPIES = 10_000


def ring(shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(cell border, shard) of all virtual nodes, clockwise; a border is a multiple of 2**47."""
    places = {}
    for shard in range(shards):
        for v in range(vnodes):
            salt = 0
            while True:
                digest = hashlib.sha256(f"{shard}/{v}/{salt}".encode()).digest()
                if (place := int.from_bytes(digest[:2], "big")) not in places:
                    break
                salt += 1
            places[place] = shard
    return sorted(places.items())


def flow(arcs: list[int], owners: list[int], shares: list[int]) -> list[list[tuple[int, int]]]:
    """Where the rows of each arc go: (rows, shard) one after the other, clockwise from their owner.

    All shards take their own rows first, in the order of the ring; then the overflow of each arc, in that order, goes on.
    """
    room = list(shares)
    out: list[list[tuple[int, int]]] = []
    rest = []
    for rows, shard in zip(arcs, owners, strict=True):
        own = min(rows, room[shard])
        room[shard] -= own
        out.append([(own, shard)] if own else [])
        rest.append(rows - own)
    for arc, rows in enumerate(rest):
        at = arc
        while rows:
            at = (at + 1) % len(owners)
            if taken := min(rows, room[shard := owners[at]]):
                room[shard] -= taken
                rows -= taken
                out[arc].append((taken, shard))
    return out


def _cells(counts: dict[int, int], bits: int, nodes: list[tuple[int, int]], shares: list[int]) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """For each cell: (rank from which on, shard, slot at that rank) in ascending order of rank."""
    borders = [place << (bits - _CELL_BITS) for place, _ in nodes]
    owners = [shard for _, shard in nodes]
    of_arc: list[list[int]] = [[] for _ in nodes]
    for cell in sorted(counts):
        of_arc[bisect_left(borders, cell) % len(nodes)].append(cell)  # the first node at or after the cell
    # cells behind the last node belong to the first one and come before those at the ring's start
    of_arc[0].sort(key=lambda c: (c <= borders[0], c))
    moved = flow([sum(counts[c] for c in cells) for cells in of_arc], owners, shares)
    slots = [0] * len(shares)
    out = []
    for cells, parts in zip(of_arc, moved, strict=True):
        starts, at = [], 0
        for rows, shard in parts:
            starts.append((at, shard, slots[shard]))
            slots[shard] += rows
            at += rows
        begin, k = 0, 0
        for cell in cells:
            end = begin + counts[cell]
            while k + 1 < len(starts) and starts[k + 1][0] <= begin:
                k += 1
            pieces, j = [], k
            while j < len(starts) and starts[j][0] < end:
                first = max(starts[j][0], begin)
                pieces.append((first - begin, starts[j][1], starts[j][2] + first - starts[j][0]))
                j += 1
            out.append((cell, pieces))
            begin = end
    return out


def shard_rows(df: DataFrame, shards: int = 16, vnodes: int = VNODES) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row."""
    spark = df.sparkSession
    text = F.coalesce("text", F.lit(""))
    keys = (
        df.select(F.col("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), text.alias("text"))
        .select("doc_id", "size", utf8_crc32("text").alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .agg(F.count("*").alias("copies"))
        .withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", "size"), 1))
    )
    keys = written(keys, "keys")
    total = keys.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    bits = max(_CELL_BITS, (total // CELL_ROWS).bit_length())
    keys = keys.withColumn("cell", F.shiftright("place", 63 - bits))
    counts = {r["cell"]: r["n"] for r in keys.groupBy("cell").agg(F.sum("copies").alias("n")).collect()}
    shares = [total // shards + (s < total % shards) for s in range(shards)]
    cells = _cells(counts, bits, ring(shards, vnodes), shares)
    pieces = spark.createDataFrame(cells, "cell long, pieces array<struct<rank long, shard int, slot long>>")
    order = Window.partitionBy("cell").orderBy("place", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keys.withColumn("rank", F.coalesce(F.sum("copies").over(order), F.lit(0))).join(pieces, "cell")
    # copies of one key are written out in parts, by as many tasks as it takes
    parts = ranked.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {_COPIES}")))).repartition(partitions(spark))
    copy = F.explode(F.sequence(F.col("part") * _COPIES, F.least(F.col("copies"), (F.col("part") + 1) * _COPIES) - 1))
    rows = parts.withColumn("copy", copy).withColumn("rank", F.col("rank") + F.col("copy"))
    piece = F.element_at(F.filter("pieces", lambda p: p["rank"] <= F.col("rank")), -1)
    placed = rows.withColumn("piece", piece)
    return placed.select("doc_id", "size", "text_crc32", F.col("piece.shard").alias("shard"), (F.col("piece.slot") + F.col("rank") - F.col("piece.rank")).alias("slot"))


def op5_consistent_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 shards, counts at most one apart."""
    placed = shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
