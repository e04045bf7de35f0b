import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from support import SF

from lodestone.llm import fingerprints as f


def sketch(text):
    return f._parse([text])[0]


def test_equal_texts_have_equal_fingerprints_whatever_stands_around_them():
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab cé漢\n") for _ in range(rnd.choice([0, 1, 2, 3, 7, 50, 400, 3000]))) for _ in range(60)]
    together = f._parse(texts)
    for text, one in zip(texts, together, strict=True):
        assert np.array_equal(one, sketch(text))


def test_shared_substrings_share_names_at_any_offset():
    rnd = random.Random(2)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    core = words(600)
    for before in (0, 1, 2, 3, 17):
        assert f.likeness(sketch(core), sketch("z" * before + core)) > 0.9
    assert f.likeness(sketch(core), sketch(words(300) + core)) > 0.4
    assert f.likeness(sketch(core), sketch(words(600))) < 0.1


def test_runs_and_periods_are_parsed():
    for text in ("a" * 10_000, "ab" * 5000, "", "a", "aa"):
        assert f.likeness(sketch(text), sketch(text)) == 1
    assert f.likeness(sketch(""), sketch("a")) == 0


M = 2**64 - 1
P = 0x9E3779B97F4A7C15


def mix(h):
    h = ((h ^ (h >> 30)) * 0xBF58476D1CE4E5B9) & M
    h = ((h ^ (h >> 27)) * 0x94D049BB133111EB) & M
    return h ^ (h >> 31)


def toss(a, b, width):
    """Twice the place of the lowest bit in which a differs from b, and a's bit there."""
    place = ((a ^ b) & -(a ^ b)).bit_length() - 1
    return 2 * (place % width) + ((a >> (place % width)) & 1)


def phrases(names):
    """One level of a text, symbol by symbol."""
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    symbols = [mix((x + n * P) & M) if n > 1 else x for x, n in runs]
    labels = [symbols[0] & 1, *(toss(a, b, 64) for a, b in zip(symbols[1:], symbols))]
    for _ in range(2):
        labels = [toss(a, b, 8) for a, b in zip(labels, [labels[0] ^ 1, *labels])]
    cuts = [0, *(i for i in range(1, len(labels) - 1) if labels[i - 1] < labels[i] > labels[i + 1]), len(symbols)]
    return [mix((sum(x * pow(P, i, 2**64) for i, x in enumerate(symbols[a:b])) + (b - a) * 0xA24BAED4963EE407) & M) for a, b in zip(cuts, cuts[1:])]


def plain(text):
    if not text:
        return []
    names, found, level = [mix(ord(c) + 0x1B873593) for c in text], set(), 0
    while True:
        if level >= (1 if len(text) < f.SHORT else f.LEVEL):
            found |= {mix(x ^ ((level * 0x2545F4914F6CDD1D) & M)) >> 32 for x in names}
        if len(names) == 1:
            return sorted(found | {mix((names[0] + 0x94D049BB133111EB) & M) >> 32})[: f.SIZE]
        names, level = phrases(names), level + 1


def plain_likeness(a, b):
    if not a or not b:
        return float(a == b)
    both = sorted(set(a) | set(b))
    both = both[: f.SIZE] if max(len(a), len(b)) >= f.SIZE else both
    return sum(x in set(a) and x in set(b) for x in both) / len(both)


def test_parsing_against_symbol_by_symbol():
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("aab cé漢\U0001f600\n") for _ in range(rnd.choice([0, 1, 2, 3, 9, 60, 199, 200, 900]))) for _ in range(80)] + ["a" * 500, "ab" * 400, "x"]
    for text, one in zip(texts, f._parse(texts), strict=True):
        assert one.tolist() == plain(text)


def test_likeness_of_edited_texts(spark):
    """The query's figures against the plain parse of every document."""
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs, reverse=True)
    got = {r["doc_id"]: r for r in f.op2_fingerprints(spark, SF).collect()}
    short = [(i, n) for i, n in zip(ids, [*ids[1:], ids[0]], strict=True) if len(docs[i]) + len(docs[n]) < 6000][:60]
    for i, n in short:
        third = len(docs[i]) // 3
        edited = docs[i][: len(docs[i]) - third] + docs[n][:third]
        a, b, c = plain(docs[i]), plain(edited), plain(docs[n])
        assert got[i]["fingerprint"] == "".join(f"{x:08x}" for x in a) and got[i]["edited_fingerprint"] == "".join(f"{x:08x}" for x in b)
        assert (got[i]["near_edited"], got[i]["near_next"]) == (plain_likeness(a, b), plain_likeness(a, c))


def test_signatures_show_a_shared_passage(spark):
    rnd = random.Random(9)
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) for _ in range(n))
    passage = words(50)
    rows = [(1, words(900) + passage + words(700)), (2, words(300) + passage), (3, words(900)), (4, None)]
    got = {r["i"]: {tuple(x) for x in r["names"]} for r in f.signatures(spark.createDataFrame(rows, "i int, text string")).collect()}
    high = {i: {n for n in names if n[0] >= 3} for i, names in got.items()}
    assert len(high[1] & high[2]) > 10 and len(high[1] & high[3]) <= 1 and not got[4]


def test_rows_of_one_id_are_cut_by_their_ties(spark):
    def pairs(batches):
        last = None
        for b in batches:
            for i, text, ahead in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                if last:
                    yield pa.RecordBatch.from_pydict({"doc_id": [last[0]], "text": [last[1]], "following": [text]})
                last = None if ahead else (i, text)

    docs = spark.range(3000).selectExpr("if(id % 3 = 0, id, 7) as doc_id", "concat('t', id) as text")
    seen = {(r["doc_id"], r["text"], r["following"]) for r in f.with_next(docs, pairs, "doc_id long, text string, following string").collect()}
    order = [(r["doc_id"], r["text"]) for r in docs.withColumn("tie", F.xxhash64("text")).orderBy(F.desc("doc_id"), "tie").collect()]
    assert seen == {(*a, b[1]) for a, b in zip(order, [*order[1:], order[0]], strict=True)}


def test_query_against_plain_code(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = sorted(docs, reverse=True)
    got = {r["doc_id"]: r for r in f.op2_fingerprints(spark, SF).collect()}
    assert set(got) == set(ids)
    for i, n in zip(ids, [*ids[1:], ids[0]], strict=True):
        edited = f.edit(docs[i], docs[n])
        assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["n_chars"] == len(docs[i])
        assert got[i]["fingerprint"] == f.fingerprint_text(sketch(docs[i]))
        assert got[i]["near_next"] == f.likeness(sketch(docs[i]), sketch(docs[n]))


def test_odd_documents(spark, odd_documents, no_documents):
    rows = f.fingerprint(odd_documents, out="score").collect()
    assert len(rows) == 10 and rows[0]["score"] == rows[1]["score"] == ""
    assert f.fingerprint(no_documents).count() == 0

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)], ["doc_id", "ahead"])

    seen = [tuple(r) for r in f.with_next(odd_documents, run, "doc_id long, ahead boolean").collect()]
    assert sorted(str(i) for i, ahead in seen if not ahead) == sorted(str(i) for i in (1, 2, 3, 4, 5, 6, 7, 8, 8, None))
    assert f.with_next(no_documents, run, "doc_id long, ahead boolean").count() == 0
