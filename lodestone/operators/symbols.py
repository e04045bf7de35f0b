"""The symbol index: which chunk a name of a file stands for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema

FULL, SIMPLE = "full", "simple"
#: Columns of chunks that names are made of, and those of the index.
NAMED = ("file_path", "full_name", "name", "kind", "contained_symbols")
COLUMNS = (*NAMED, "chunk_id", "ord")


def _rows(chunks: DataFrame, *carried: str) -> DataFrame:
    """(path, tbl, q, place) of each name of a chunk, folded ones included."""
    own = chunks.where(F.col("kind").isin(schema.DEFINITION, schema.DEFINITION_SKELETON))
    folded = F.transform("contained_symbols", lambda s, i: F.struct(F.lit(FULL).alias("tbl"), s.alias("q"), (i + 1).alias("place")))
    names = F.array(F.struct(F.lit(FULL).alias("tbl"), F.col("full_name").alias("q"), F.lit(0).alias("place")), F.struct(F.lit(SIMPLE).alias("tbl"), F.col("name").alias("q"), F.lit(0).alias("place")))
    return own.select(F.col("file_path").alias("path"), *carried, F.inline(F.concat(names, folded)))


def known_names(chunks: DataFrame) -> DataFrame:
    """(tbl, path, q): the names of the index, without ids."""
    return _rows(chunks).select("tbl", "path", "q").distinct()


def symbol_index(chunks: DataFrame) -> DataFrame:
    """(tbl, path, q, chunk_id): the first chunk of each full name, folded ones included, and of each simple name."""
    return _rows(chunks, "chunk_id", "ord").groupBy("tbl", "path", "q").agg(F.min_by("chunk_id", F.struct("ord", "place")).alias("chunk_id"))
