import random

import pytest
from llm_support import shingles
from support import SF

from lodestone.llm import jaccard_join as j
from lodestone.llm._shared import Scratch
from lodestone.llm.components import components


def plain(texts, k, percent):
    """Least number of the texts that can be reached by links, for each text."""
    sets = [shingles(t, k) for t in texts]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


def corpus(rnd):
    """Texts of few words, in families of copies with edits, with passages that many share."""
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    passage, texts = say(30), []
    for _ in range(25):
        base = say(rnd.choice([3, 10, 40, 120]))
        for _ in range(rnd.choice([1, 1, 2, 5])):
            words = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [" ".join(passage + say(rnd.choice([2, 5, 40]))) for _ in range(40)]
    chain = say(60)
    for _ in range(30):
        chain = list(chain)
        chain[rnd.randrange(60)] = rnd.choice(vocabulary)
        texts.append(" ".join(chain))
    texts += ["", "A b", "a B", " \n", "one", "One"]
    rnd.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "region", "centres"), [(1, 64, 32), (2, 3, 32), (3, 2, 2), (4, 2, 1)])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, seed, region, centres):
    monkeypatch.setattr(j, "REGION", region)
    monkeypatch.setattr(j, "CENTRES", centres)
    texts = corpus(random.Random(seed))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    sizes, least = plain(texts, 4, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.groups(docs, 4, 85).collect()}
    assert got == {i: (sizes[i], least[i]) for i in range(len(texts))}


def test_components_of_chains_stars_and_pairs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300)]
    with Scratch(spark) as scratch:
        got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect())
        assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
        assert components(spark.createDataFrame([], "a long, b long"), scratch).count() == 0


def test_query_against_all_pairs(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    sizes, least = plain([t for _, t in docs], 4, 85)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.op8_jaccard_join(spark, SF).collect()}
    assert got == {i: (sizes[k], docs[least[k]][0]) for k, (i, _) in enumerate(docs)}


def test_one_of_each(spark):
    texts = corpus(random.Random(9))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp1 string")
    _, least = plain(texts, 5, 80)
    assert {r["doc_id"] for r in j.one_of_each(docs).collect()} == set(least)
    assert j.one_of_each(docs).columns == docs.columns


def test_odd_documents(spark, odd_documents, no_documents):
    got = sorted((r["doc_id"] is None, r["doc_id"], r["component_id"], r["n_shingles"]) for r in j.groups(odd_documents, 4, 85).collect())
    assert [g[1:3] for g in got] == [(i, i) for i in (1, 2, 3, 4, 5, 6, 7, 8, 8, None)]
    assert [g[3] for g in got[:5]] == [0, 0, 0, 1, 9]
    assert j.groups(no_documents).count() == 0
    kept = j.one_of_each(odd_documents)
    assert sorted(r["source"] for r in kept.collect()) in ([f"s{k}" for k in (0, 1, 2, 3, 4, 5, 6, 7, 9)], [f"s{k}" for k in (0, 1, 2, 3, 4, 5, 6, 8, 9)])
    same = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (3, "A b c d e f"), (3, "a b c d e f"), (4, "x y z")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in j.one_of_each(same).collect()) == [3, 4]
