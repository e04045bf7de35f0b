"""Scalar functions of the data model, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import settings


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed a single time, however often ``f`` uses it; a binary column is copied at each use otherwise."""
    return F.element_at(F.transform(F.array(value), f), 1)


def byte_text(content: Column, start: Column, end: Column) -> Column:
    """Bytes from start (0-based) to end, as text."""
    return F.decode(F.substring(content, start + 1, end - start), "UTF-8")


def chunk_id(path: Column, start: Column, full_name: Column) -> Column:
    """Stable id: the first hex digits of a SHA-1 over path, start and full name."""
    return F.substring(F.sha1(F.concat_ws(":", path, start.cast("string"), full_name).cast("binary")), 1, settings.CHUNK_ID_LENGTH)


def file_skeleton_id(path: Column) -> Column:
    return chunk_id(path, F.lit(0), F.concat(F.lit("<file_skeleton:"), path, F.lit(">")))


def full_name(name: Column, namespace: Column, enclosing_class: Column) -> Column:
    return (
        F.when(F.size(namespace) > 0, F.concat_ws(".", namespace, name)).when(enclosing_class.isNotNull() & (enclosing_class != ""), F.concat_ws(".", enclosing_class, name)).otherwise(name)
    )


def clean_parts(text: Column) -> Column:
    """Dotted parts of a reference, each up to its first bracket."""
    return F.transform(F.split(text, r"\.", -1), lambda p: F.regexp_extract(p, r"^([^(\[]*)", 1))


def strip_quotes(text: Column) -> Column:
    return F.regexp_replace(text, "^[\"'`]+|[\"'`]+$", "")


def looks_relative(text: Column) -> Column:
    return F.startswith(strip_quotes(text), F.lit("."))


def join_module(module: Column, name: Column) -> Column:
    return F.concat(module, F.when(F.endswith(module, F.lit(".")), "").otherwise("."), name)


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def derived_import_name(module: Column) -> Column:
    """The name by which an import path is referred to: its last segment."""
    return last_segment(F.regexp_replace(strip_quotes(module), "/+$", ""))


def repository_host(url: Column) -> Column:
    """Host of an https URL or git@host:path; null for other schemes."""
    return F.when(F.startswith(url, F.lit("https:")), F.lower(F.regexp_extract(url, r"^https://(?:[^/@]*@)?([^/:?#]*)", 1))).when(
        F.startswith(url, F.lit("git@")), F.regexp_extract(url, r"^git@([^:]*)", 1)
    )


def allowed_host(url: Column, hosts: tuple[str, ...] = settings.ALLOWED_REPOSITORY_HOSTS) -> Column:
    return F.coalesce(repository_host(url).isin(*hosts), F.lit(False))


def valid_ref(ref: Column) -> Column:
    return ref.rlike(rf"\A[a-zA-Z0-9][a-zA-Z0-9._/\-]{{0,{settings.MAX_REF_LENGTH}}}\z")
