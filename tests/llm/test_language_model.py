import math
import zlib
from collections import Counter

import numpy as np
from llm_support import WORD, lower
from support import SF

from lodestone.llm import language_model as m


def plain(documents):
    """Counts and base scores of (doc_id, text) rows."""
    fold = lambda i: 0 if i is None else zlib.crc32(str(i).encode()) % 10
    tokens = [(i, [*WORD.findall(lower(t)), None]) for i, t in documents]
    learned = Counter(w for i, ws in tokens if fold(i) for w in ws)
    total, distinct = sum(learned.values()), len(learned)
    base = lambda w: math.log10((learned[w] + 0.1) / (total + 0.1 * (distinct + 1)))
    return [(i, fold(i) == 0, len(ws), sum(learned[w] > 0 for w in ws), total, sum(map(base, ws))) for i, ws in tokens]


def test_query_against_plain_counts_and_better_than_base(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in m.op9_language_model(spark, SF).collect()}
    assert len(got) == len(docs)
    sums = [0.0, 0.0]
    for i, held, n, known, total, base in plain(docs):
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        if held:
            sums[0] += r["base_score"]
            sums[1] += r["score"]
    assert sums[1] > sums[0]  # held-out text is likelier than by the base


def test_probabilities_sum_to_one(spark):
    texts = ["a b c a b", "a a b d", "c d e", "", "b a b a b"] * 20
    documents = m.with_folds(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    words = m.written(m.count_words(documents), "words")
    model = m.learn(documents, words)
    factor, constant, _ = model.parts()
    counts = {h: n for h, n in words.collect()}
    kinds = dict(zip(model.common.view(np.int64).tolist(), model.classes.tolist(), strict=True))
    for context in range(len(constant)):
        if not model.cells[context].sum():
            continue
        known = sum(factor[context, kinds.get(h, 0)] * n + constant[context] for h, n in counts.items())
        assert math.isclose(known + constant[context], 1, rel_tol=1e-6)  # all known words and one that isn't
    assert np.allclose(model.weights.sum(axis=1), 1)


def test_em_finds_the_mixture():
    rng = np.random.default_rng(1)
    p2, p1 = rng.random(2000) * 0.1, rng.random(2000) * 0.01
    weights = m._em(p2, p1, 1e-6, 0.7 * p2 + 0.25 * p1 + 0.05 * 1e-6)
    assert weights[0] > weights[1] > weights[2] and math.isclose(weights.sum(), 1)


def test_odd_documents(spark, odd_documents, no_documents):
    for frame in (odd_documents, no_documents):
        documents = m.with_folds(frame)
        words = m.written(m.count_words(documents), "words")
        rows = m.score(documents, words, m.learn(documents, words)).collect()
        expected = sorted(((str(i), n, known, round(base, 6)) for i, _, n, known, _, base in plain([(r["doc_id"], r["text"]) for r in frame.collect()])))
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in rows) == expected
        assert all(r["score"] <= 0 for r in rows)


def test_a_repeated_row_is_scored_each_time(spark):
    docs = spark.createDataFrame([(3, "a b zz"), (3, "a b zz"), (3, "q"), (4, "a a a")], "doc_id long, text string")
    documents = m.with_folds(docs)
    words = m.written(m.count_words(documents), "words")
    rows = m.score(documents, words, m.learn(documents, words)).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in rows) == [(3, 2), (3, 4), (3, 4), (4, 4)]


def test_bigrams_are_of_words(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    documents = m.with_folds(spark.createDataFrame(docs, "doc_id long, text string"))
    words = m.written(m.count_words(documents), "words")
    model = m.learn(documents, words)
    fold = lambda i: zlib.crc32(str(i).encode()) % 10
    tokens = {i: ["^", *WORD.findall(lower(t)), None] for i, t in docs}
    c1 = Counter(w for i, ws in tokens.items() if fold(i) for w in ws)
    c2 = Counter(p for i, ws in tokens.items() if fold(i) for p in zip(ws, ws[1:]))
    total, distinct = sum(n for w, n in c1.items() if w != "^"), len(c1) - 1
    got = {r["doc_id"]: r["score"] for r in m.score(documents, words, model).collect()}
    others = m.score(documents.select("doc_id", "text"), words, model).collect()  # as documents that the model doesn't know
    assert {r["doc_id"]: round(r["score"], 6) for r in others} == {i: round(s, 6) for i, s in got.items()}
    for i, ws in tokens.items():
        expected = 0.0
        for u, w in zip(ws, ws[1:]):
            a, b, c = model.weights[c1[u].bit_length()]
            expected += math.log10(a * c2[u, w] / max(c1[u], 1) + b * c1[w] / total + c / (distinct + 1))
        assert math.isclose(got[i], expected, rel_tol=1e-9)


def test_rare_words_that_go_together_are_likelier_together(spark):
    pairs = " ".join(f"x{k} y{k}" for k in range(1500))  # each word has 1/3000 of the tokens
    learned = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10]
    new = [i for i in range(100, 200) if not zlib.crc32(str(i).encode()) % 10][:2]
    rows = [*((i, pairs) for i in learned), (new[0], "x7 y7"), (new[1], "x7 y8")]
    documents = m.with_folds(spark.createDataFrame(rows, "doc_id long, text string"))
    words = m.written(m.count_words(documents), "words")
    got = {r["doc_id"]: r["score"] for r in m.score(documents, words, m.learn(documents, words)).collect()}
    assert got[new[0]] > got[new[1]] + 1
