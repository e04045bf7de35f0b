"""What one looks at after ingesting a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema

#: Columns of references that samples are made of.
SAMPLED = ("file_path", "chunk_ord", "ord", "chunk_name", "text")
STATUSES = (schema.LOCAL, schema.EXTERNAL, schema.BUILTIN, schema.UNRESOLVED)


def skip_counts(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("reason").agg(F.count("*").alias("n"))


def status_counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("status").agg(F.count("*").alias("n"))


def totals(files: DataFrame, chunks: DataFrame, names: DataFrame) -> DataFrame:
    """One row: files, chunks, refs and the number of refs of each status; of names with their number of refs, ``n``."""
    number = lambda n: F.coalesce(F.sum(n), F.lit(0))
    counted = names.agg(number(F.col("n")).alias("refs"), *(number(F.when(F.col("status") == s, F.col("n"))).alias(s) for s in STATUSES))
    return files.agg(F.count("*").alias("files")).crossJoin(chunks.agg(F.count("*").alias("chunks"))).crossJoin(counted)  # one row each


def sample(refs: DataFrame, status: str, n: int) -> DataFrame:
    """The first references of a status in the order of file, chunk and place."""
    rows = refs.where(F.col("status") == status).orderBy("file_path", "chunk_ord", "ord").limit(n)
    return rows.select("file_path", "chunk_name", "text", "points_to")


def suspicious(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Unresolved references whose first part is a name, or whose text is a full name, that some definition has."""
    own = chunks.where(F.col("kind") == schema.DEFINITION)
    names = own.select(F.explode(F.array(F.struct(F.lit("name").alias("t"), F.col("name").alias("q")), F.struct(F.lit("full").alias("t"), F.col("full_name").alias("q")))).alias("k")).select("k.*").distinct()
    rows = refs.where(F.col("status") == schema.UNRESOLVED)
    keys = F.array(F.struct(F.lit("name").alias("t"), F.element_at(F.split("text", r"\.", -1), 1).alias("q")), F.struct(F.lit("full").alias("t"), F.col("text").alias("q")))
    hits = rows.select("file_path", "ord", "chunk_name", "text", F.inline(keys)).join(names, ["t", "q"], "left_semi")
    return hits.select("file_path", "ord", "chunk_name", "text").distinct()
