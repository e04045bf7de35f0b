import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from support import SF

from lodestone.llm import sharding as s


def check(rows, shards):
    counts = Counter(r["shard"] for r in rows)
    assert max(counts.values()) - min([counts[k] for k in range(shards)]) <= 1
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_query_balances_rows_and_keeps_them(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = s.op5_consistent_hash(spark, SF).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((d["doc_id"], len((d["text"] or "").encode()) + 1, zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert {r["law"] for r in rows} == {"rows"} and all(r["grown_shard"] is None for r in rows)
    check(rows, 16)


def test_flow_against_rows_one_by_one():
    rnd = random.Random(5)
    for _ in range(200):
        shards, nodes = rnd.randint(1, 5), rnd.randint(5, 20)
        owners = [*range(shards), *(rnd.randrange(shards) for _ in range(nodes - shards))]
        rnd.shuffle(owners)
        arcs = [rnd.randint(0, 9) for _ in owners]
        total = sum(arcs)
        shares = [total // shards + (k < total % shards) for k in range(shards)]
        room, placed, late = list(shares), defaultdict(list), []
        for a, n in enumerate(arcs):
            for _ in range(n):
                if room[owners[a]]:
                    room[owners[a]] -= 1
                    placed[a].append(owners[a])
                else:
                    late.append(a)
        for a in late:
            at = a
            while not room[owners[at]]:
                at = (at + 1) % len(owners)
            room[owners[at]] -= 1
            placed[a].append(owners[at])
        moved = s.flow(arcs, owners, shares)
        assert [[shard for rows, shard in parts for _ in range(rows)] for parts in moved] == [placed[a] for a in range(len(arcs))]


def test_placement_against_rows_one_by_one(spark):
    """Each row looks for its owner on the ring; rows of an arc come in the order of their places, overflow goes on clockwise."""
    docs = spark.range(700).selectExpr("id as doc_id", "concat('text ', id) as text")
    hashed = docs.select("doc_id", F.xxhash64("doc_id", F.crc32(F.col("text").cast("binary")), (F.octet_length("text") + 1).cast("long")).alias("h")).collect()
    place = {r["doc_id"]: (r["h"] & (2**64 - 1)) >> 1 for r in hashed}
    shards, nodes = 5, s.ring(5, 3)
    borders = [b << 47 for b, _ in nodes]
    step = 1 << 47  # rows of the cell that a node stands at belong to it

    def arc(p):
        return next((k for k, b in enumerate(borders) if p < b + step), 0)

    order = sorted(place, key=lambda i: (arc(place[i]), arc(place[i]) == 0 and place[i] < borders[0] + step, place[i]))
    room, found, late = [140] * shards, {}, []
    for i in order:
        if room[owner := nodes[arc(place[i])][1]]:
            room[owner] -= 1
            found[i] = owner
        else:
            late.append(i)
    for i in late:
        at = arc(place[i])
        while not room[nodes[at % len(nodes)][1]]:
            at += 1
        room[nodes[at % len(nodes)][1]] -= 1
        found[i] = nodes[at % len(nodes)][1]
    assert late and {r["doc_id"]: r["shard"] for r in s.shard_rows(docs, shards, 3).collect()} == found


def test_one_more_shard_moves_few_rows(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "cast(id as string) as text")
    for n, most in ((8, 0.2), (16, 0.13)):  # one shard's share: 0.111, 0.059
        before, after = ({r["doc_id"]: r["shard"] for r in s.shard_rows(docs, k).collect()} for k in (n, n + 1))
        assert sum(before[i] != after[i] for i in before) < most * len(before)


def test_odd_and_hot_documents(spark, odd_documents, no_documents):
    rows = s.shard_rows(odd_documents, 3).collect()
    assert len(rows) == 10
    check(rows, 3)
    assert s.shard_rows(no_documents).count() == 0
    hot = spark.range(30_000).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "if(id % 3 = 0, 'same', cast(id as string)) as text")
    rows = s.shard_rows(hot, 7).collect()
    assert len(rows) == 30_000
    check(rows, 7)
