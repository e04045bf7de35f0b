"""The one Python boundary: bytes of a file to rows of what it defines, refers to and imports."""

from __future__ import annotations

import gc
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import schema
from ..errors import ChunkDecodeError, IngestionError, TreeSitterParseError
from ..languages import BY_EXTENSION, front_end
from ..parsing.model import LISTS

_BATCH_BYTES = 4 << 20
_OUT = T.StructType([T.StructField("path", T.StringType()), T.StructField("language", T.StringType()), T.StructField("content", T.BinaryType()), *schema.PARSED.fields])


def language_of(path):
    """Language by extension; null for others."""
    out = F.lit(None).cast("string")
    for extension, language in BY_EXTENSION.items():
        out = F.when(F.endswith(path, F.lit(extension)), language.name).otherwise(out)
    return out


def parse_one(language: str, content: bytes, wanted: Collection[str] = LISTS) -> dict:
    """The row of one file with the wanted lists, or one with nothing but the name of the error that it meets."""
    collected = gc.isenabled()
    gc.disable()  # a large file's tree has no cycles, but would be searched for them over and over
    try:
        parser = front_end(language)
        return (parser(content) if "raw_refs" in wanted else parser(content, refs=False)).finish(wanted)
    except IngestionError as error:
        return {"parse_error": type(error).__name__}
    except UnicodeDecodeError:
        return {"parse_error": ChunkDecodeError.__name__}
    except (RecursionError, IndexError, KeyError, ValueError):
        return {"parse_error": TreeSitterParseError.__name__}
    finally:
        if collected:
            gc.enable()


def parse(files: DataFrame, wanted: Collection[str] = LISTS) -> DataFrame:
    """(path, language, content) to the same with the columns of ``schema.PARSED``, lists that aren't wanted being null; one row a file, no shuffle."""
    arrow = to_arrow_schema(_OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, language, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                rows.append({"path": path, "language": language, "content": content, **parse_one(language, content, wanted)})
                size += len(content)
                if size > _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return files.select("path", "language", "content").mapInArrow(run, _OUT)
