import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from support import SF

from lodestone.llm import decontaminate as d

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))


def plain(text, items, window):
    said, hit, found = words(text), set(), set()
    for i, t in items:
        w = words(t)
        k = min(window, len(w))
        for a in range(len(w) - k + 1) if w else ():
            for b in range(len(said) - k + 1):
                if said[b : b + k] == w[a : a + k]:
                    hit.update(range(b, b + k))
                    found.add("" if i is None else str(i))
    return len(said), len(hit), sorted(found)


def marked(frame):
    return [(r["n_words"], sum(r["hit_lengths"]), list(r["items"])) for r in frame.collect()]


def compare(spark, texts, items, window):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], sum(r["hit_lengths"]), list(r["items"])) for r in d.mark(docs, bench, window).collect()}
    assert got == {i: plain(t, items, window) for i, t in enumerate(texts)}
    kept = {r["doc_id"] for r in d.decontaminate(docs, bench, window).collect()}
    assert kept == {i for i, g in got.items() if not g[1]}


def test_random_texts_of_few_words(spark):
    rnd = random.Random(6)
    say = lambda n: " ".join(rnd.choice("ab") for _ in range(n))
    items = [(k, say(rnd.choice([0, 1, 3, 8, 12, 30]))) for k in range(6)] + [(None, "B a-b, A!"), (3, "a a a a"), (9, None)]
    compare(spark, [say(rnd.randint(0, 60)) for _ in range(30)] + [None, "", "é a b"], items, 4)
    compare(spark, [say(rnd.randint(0, 60)) for _ in range(10)], [(1, say(40))], 20)


def test_a_benchmark_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 60)
    rnd = random.Random(8)
    say = lambda n: " ".join(rnd.choice("abc") for _ in range(n))
    compare(spark, [say(40) for _ in range(20)], [(k, say(9)) for k in range(8)], 5)


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    bench = d.Benchmark([(1, "aa bb cc")], 3)

    class Twins(d.Words):
        def __init__(self, *args, **kwargs):
            super().__init__(*args, **kwargs)
            for i, word in enumerate(self.spelled(np.arange(len(self.hashes)))):
                if word == b"zz":
                    self.hashes[i] = bench.words[1]

    monkeypatch.setattr(d, "Words", Twins)
    added = ["n_words", "hit_starts", "hit_lengths", "items", "longest"]
    batch = pa.RecordBatch.from_pydict({"text": ["aa zz cc", "aa bb cc aa zz cc"]})
    (out,) = d._marker(SimpleNamespace(value=bench), "text", ["text"], added, False)(batch)
    assert out.column("hit_starts").to_pylist() == [[], [0]] and out.column("items").to_pylist() == [[], ["1"]]


def test_longest_match_goes_beyond_the_window(spark):
    item = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 z")], "doc_id long, text string")
    got = {r["doc_id"]: (r["longest"], list(r["hit_starts"]), list(r["hit_lengths"])) for r in d.mark(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (40, [1], [40]), 2: (10, [0], [10])}


def test_query_against_plain_code(spark):
    import hashlib

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {}
    for i, t in items:
        w = words(t)
        for a in range(max(len(w) - 9, 1)) if w else ():
            windows.setdefault(tuple(w[a : a + 10]), set()).add(str(i))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in d.op6_decontaminate(spark, SF).collect():
        said, hit, found = words(docs[r["doc_id"]]), set(), set()
        for b in range(len(said)):
            for k in {len(w) for w in windows}:
                if names := windows.get(tuple(said[b : b + k])):
                    found |= names
                    hit.update(range(b, b + k))
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (len(said), len(hit), len(found), bool(hit))
        assert r["items_sha256"] == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_odd_documents(spark, odd_documents, no_documents):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, "A")], "item_id long, text string")
    kept = d.decontaminate(odd_documents.withColumnRenamed("score", "items"), bench)
    assert sorted(r["source"] for r in kept.collect()) == ["s0", "s1", "s2", "s5", "s6", "s7", "s8", "s9"]
    assert d.mark(no_documents, bench).count() == 0
    assert d.decontaminate(odd_documents, bench.limit(0)).count() == 10
