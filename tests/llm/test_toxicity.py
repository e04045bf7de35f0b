import zlib

import numpy as np
import pytest
from support import SF

from lodestone.llm import toxicity as x


@pytest.mark.parametrize(
    ("shown", "meant"),
    [("You M0R0N!", "you moron"), ("іdiot", "idiot"), ("ＩＤＩＯＴ", "idiot"), ("st​uṕid", "stupid"), ("l0s3r", "loser"), ("$tupid", "tupid"), ("tra$h", "trash"), ("1990", "1990"), ("scum!!! 12", "scum 12"), ("", "")],
)
def test_disguises_fold(shown, meant):
    assert x.fold_phrase(shown).split() == meant.replace("l", "i").split()


def lexicon(curve=(-2.0, 1.0, 0.0)):
    entries = tuple((f" {w.replace('l', 'i')} ", 5.0) for w in ("idiot", "trash")) + ((" vequ", 4.0),)
    return x.Lexicon(entries, ("trash can",), curve)


def test_hits_count_where_no_exception_covers_them():
    texts = ["an idi0t in the trash can", "trash and TRASH", "", "vequille vequs", "no can trash"]
    weight, hits, words = x.weigh(texts, lexicon().dumps())
    assert (weight.tolist(), hits.tolist(), words.tolist()) == ([5.0, 10.0, 0.0, 8.0, 5.0], [1, 2, 0, 2, 1], [6, 3, 0, 2, 3])


def test_chunks_do_not_change_a_weight():
    texts = ["idiot", "a trash", "", "x" * 100, "trash can idiot", "é idiot"]
    whole = x.weigh(texts, lexicon().dumps())
    for k, t in enumerate(texts):
        assert [a[0] for a in x.weigh([t], lexicon().dumps())] == [a[k] for a in whole]


def test_held_out_documents_are_told_apart(spark):
    rows = []
    rng = np.random.default_rng(7)
    common = [f"w{i}" for i in range(300)]
    for i in range(600):
        words = list(rng.choice(common, 60))
        toxic = i % 5 == 0
        if toxic:
            for at, w in zip(rng.integers(0, 60, 3), rng.choice(["grobnik", "fl3rp", "zonkish", "zonked"], 3), strict=True):
                words[at] = str(w)
        rows.append((i, " ".join(map(str, words)), int(toxic)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows], "doc_id long, toxic int, quality int")
    made = x.learn(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in x.score(docs, made).collect()}
    held = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == y for a, y in held) / len(held) > 0.97
    kept = {r["doc_id"] for r in x.remove_toxic(docs, made).collect()}
    assert kept == {i for i, p in got.items() if p == 0}


def test_a_beginning_needs_two_words_and_no_clean_ones():
    strong = {" tra": 5.0, " tras": 7.0, " trash ": 7.2, " trashy ": 7.1, " wor": 4.0, " worthy ": 4.9, " worm ": 4.0, " mor": 7.0, " moron ": 7.0, " trashe": 6.0}
    assert dict(x._stems(strong)) == {" tras": 7.0, " worthy ": 4.9, " worm ": 4.0, " moron ": 7.0}


def test_exceptions_are_learned(spark):
    rng = np.random.default_rng(3)
    common = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(900):
        words = [str(w) for w in rng.choice(common, 40)]
        toxic = int(i % 6 == 0)
        at = int(rng.integers(1, 38))
        if toxic:
            words[at] = "grobnik"
        elif i % 36 == 1:
            words[at : at + 2] = ["grobnik", "Tower"]
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    made = x.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    assert [e for e, _ in made.weights] == [" grobnik "] and made.exceptions == ("grobnik tower",)
    tried = spark.createDataFrame([(1, "a grobnik tower"), (2, "a grobnik towers"), (3, "grobnik")], "doc_id long, text string")
    assert [r["toxic_hits"] for r in x.score(tried, made).orderBy("doc_id").collect()] == [0, 1, 1]


def test_odd_documents_and_labels(spark, odd_documents, no_documents):
    rows = x.score(odd_documents, lexicon()).collect()
    assert len(rows) == 10 and all(0 <= r["score"] <= 1 for r in rows)
    assert rows[0].asDict().keys() >= {"lang", "source", "text", "score", "predicted"}
    assert x.remove_toxic(odd_documents, lexicon()).columns == odd_documents.columns
    assert x.score(no_documents, lexicon()).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert x.learn(odd_documents, none).weights == ()
    nulls = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 1), (3, 0)], "doc_id long, toxic int")
    made = x.learn(odd_documents, nulls)
    assert all(r["predicted"] == 0 for r in x.score(odd_documents, made).collect())


def test_query_scores_every_document(spark):
    rows = x.op4_toxicity(spark, SF).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
