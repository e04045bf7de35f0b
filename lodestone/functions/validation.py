"""Which files are worth parsing, as column expressions over path, length and content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema, settings
from .columns import once

BINARY_SAMPLE, MINIFIED_SAMPLE = 1024, 8192
LONG_LINE, LONG_RATIO, FEW_LINES = 200, 0.7, 10
_CONTROL = r"[\x00-\x06\x0b\x0e-\x1a\x1c-\x1f]"


def _latin(content: Column, size: int) -> Column:
    """The first bytes, a character each."""
    return F.decode(F.substring(content, 1, size), "ISO-8859-1")


def is_empty(length: Column) -> Column:
    return length == 0


def is_oversized(length: Column, max_mb: float = settings.MAX_FILE_SIZE_MB) -> Column:
    return length > F.lit(max_mb * settings.BYTES_PER_MB)


def is_binary(content: Column) -> Column:
    return _latin(content, BINARY_SAMPLE).rlike(_CONTROL)


def line_lengths(content: Column) -> Column:
    """Bytes of the lines of the sample; a line that the sample cuts is left out if there are others."""

    def kept(lines: Column) -> Column:
        n = F.size(lines) - (F.element_at(lines, -1) == "").cast("int")
        return F.transform(F.slice(lines, 1, n - ((F.octet_length(content) > MINIFIED_SAMPLE) & (n > 1)).cast("int")), F.length)

    return once(F.split(_latin(content, MINIFIED_SAMPLE), "\r\n|\r|\n", -1), kept)


def is_minified(path: Column, content: Column) -> Column:
    """A name like x.min.js, or mostly very long lines."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/", -1), -1), r"(?<=.)\.[^.]*$", "")

    def mostly_long(lengths: Column) -> Column:
        n, total = F.size(lengths), F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
        return once(F.size(F.filter(lengths, lambda x: x > LONG_LINE)), lambda long: F.when(n == 0, False).when(n < FEW_LINES, long == n).otherwise((long >= n * LONG_RATIO) & (total > n * LONG_LINE)))

    return F.when(F.endswith(stem, F.lit(".min")), True).otherwise(once(line_lengths(content), mostly_long))


def path_reason(length: Column, max_mb: float = settings.MAX_FILE_SIZE_MB) -> Column:
    return F.when(is_empty(length), schema.EMPTY).when(is_oversized(length, max_mb), schema.OVERSIZED)


def content_reason(path: Column, content: Column) -> Column:
    return F.when(is_binary(content), schema.BINARY).when(is_minified(path, content), schema.MINIFIED)


def skip_reason(path: Column, length: Column, content: Column, error: Column, max_mb: float = settings.MAX_FILE_SIZE_MB) -> Column:
    """Why a file is skipped, the first reason; null if it isn't."""
    return F.coalesce(path_reason(length, max_mb), error, content_reason(path, content))
