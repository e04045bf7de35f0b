import hashlib

import corpus_pipeline as p
from pyspark.sql import functions as F
from llm_support import shingles
from support import SF
from test_decontaminate import plain as leaks
from test_jaccard_join import plain as near

from lodestone.llm import toxicity


def test_stages_against_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = []
    for _, stage in p.STAGES:
        docs = p.written(stage(spark, docs, SF), "stage")
        kept.append({r["doc_id"] for r in docs.collect()})
        if stage is not p.encode:
            assert docs.columns == p.COLUMNS
    made = toxicity.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    scored = toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), made)
    assert kept[0] == {r["doc_id"] for r in scored.where("predicted = 0").collect()}
    ids = sorted(kept[0])
    _, least = near([text[i] for i in ids], 5, 80)
    assert kept[1] == {ids[k] for k in least}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {w for _, t in items for w in shingles(t, 10)}
    suspects = {i for i in kept[1] if any(s in (text[i] or "").lower() for s in {" ".join(list(w)[:3]).lower() for w in windows})}
    assert kept[2] == kept[1] - {i for i in suspects if leaks(text[i], items, 10)[1]}
    assert kept[3] == kept[2]


def test_run_gives_the_ids_of_the_library(spark):
    from test_byte_bpe import library

    encoding = library()
    text = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = p.run(spark, SF).collect()
    assert rows and all(r["round_trip"] for r in rows)
    for r in rows:
        ids = encoding.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_odd_documents(spark, odd_documents, no_documents):
    docs = odd_documents.withColumn("__0", F.lit(1)).withColumn("label", F.lit("x"))
    kept = []
    for _, stage in p.STAGES:
        docs = p.written(stage(spark, docs, SF), "stage")
        kept.append(sorted((r["doc_id"] is None, r["doc_id"]) for r in docs.collect()))
    whole = [(False, i) for i in (1, 2, 3, 4, 5, 6, 7, 8, 8)] + [(True, None)]
    assert kept[0] == whole
    assert kept[1] in ([k for k in whole if k != (False, 8)] + [(False, 8)], sorted(set(whole)))
    assert kept[2] == kept[3] == kept[1]
    assert {r["doc_id"]: r["n_tokens"] for r in docs.collect()}[1] == 0
    assert all(r["round_trip"] for r in docs.collect())
    for _, stage in p.STAGES:
        no_documents = stage(spark, no_documents, SF)
    assert no_documents.count() == 0
