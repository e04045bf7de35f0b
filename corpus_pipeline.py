"""A corpus in four stages: no toxic documents, no near-duplicates, no benchmark leaks, then token ids.

Each stage takes (spark, docs, sf_dir), with the columns of ``documents``, and works on all that
the one before has kept; what it returns is written as Parquet and read again.

Defined results: only the columns of ``documents`` are kept, whatever others there are and whatever their
names.  A null or empty text has the lexicon's score for none, is nobody's near-duplicate, holds no leak and
has no tokens, so it stays unless its fellows are toxic for having nothing.  Of rows of equal id and
equal text one stays; of rows of equal id and different texts each is judged by its own text.  A null
doc_id is a document like any other, but stays only if its group has no other.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, decontaminate, jaccard_join, toxicity
from lodestone.llm._shared import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon doesn't reject; it is learned from labelled documents of this input."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.remove_toxic(docs.select(COLUMNS), lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, by five-word shingles at a similarity of 0.8: the one of the least doc_id."""
    return jaccard_join.one_of_each(docs.select(COLUMNS))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten words of a benchmark item occur."""
    return decontaminate.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and digest, decoded again as a check."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.encode(docs.select("doc_id", "text"), path, decoded=True).select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("token_ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("byte_bpe", encode),
]

#: Learned weights and merges by rank are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
