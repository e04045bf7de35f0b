"""Chunks of parsed files, as array expressions over a file's definitions: no join and no shuffle.

A definition is a chunk if it stands at the top of its file or if the definition around it is over the
budget.  It is kept whole if it fits the budget or holds no other definition, and is a skeleton
otherwise.  As ranges only grow upwards, that is what a walk from the top would give.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema, settings
from ..errors import InvalidChunkBudgetError
from ..functions.columns import byte_text, chunk_id, file_skeleton_id, full_name, last_segment, once
from ..languages import REGISTRY


KINDS = (schema.FILE_SKELETON, schema.DEFINITION, schema.DEFINITION_SKELETON)


def check_budgets(budget: int, threshold: int) -> None:
    if budget <= 0 or threshold <= 0:
        raise InvalidChunkBudgetError(f"budget {budget} and threshold {threshold} must be positive")


def _size(d: Column) -> Column:
    return d["end"] - d["start"]


def _parent(d: Column) -> Column:
    return F.get(F.col("defs"), d["parent"])


def _footer() -> Column:
    """Closing line of a skeleton by language; null for none."""
    out = F.lit(None).cast("string")
    for language in REGISTRY:
        if language.footer:
            out = F.when(F.col("language") == language.name, language.footer).otherwise(out)
    return out


def _lines(parts: Column, indent: str) -> Column:
    return F.transform(parts, lambda p: F.concat(F.lit(indent), F.coalesce(p["sig"], p["text"])))


def _skeleton(d: Column) -> Column:
    """Head, a line for each part of the body (a stub for what is a definition itself), footer."""
    members = _lines(d["body"], "    ")
    body = F.when(F.size(members) > 0, members).otherwise(F.array(F.lit("    ...")))
    lines = F.when(d["has_body"], F.concat(F.array(d["sig"]), body)).otherwise(F.array(F.concat(d["sig"], F.lit("..."))))
    return F.array_join(F.concat(lines, F.when(_footer().isNotNull(), F.array(_footer())).otherwise(F.array().cast("array<string>"))), "\n")


def _emitted(d: Column, budget: Column) -> Column:
    """Whether a definition is a chunk."""
    return (d["parent"] < 0) | (_size(_parent(d)) > budget)


def _name(d: Column) -> Column:
    return full_name(d["name"], d["namespace"], d["enclosing_class"])


def _id(d: Column) -> Column:
    return chunk_id(F.col("path"), d["start"], _name(d))


def annotate(parsed: DataFrame, budget: int = settings.DEFINITION_BUDGET, threshold: int = settings.FILE_SKELETON_THRESHOLD) -> DataFrame:
    """Files without errors, with the budget and the id of the file's overview (null for small files)."""
    check_budgets(budget, threshold)
    file_id = F.when(F.octet_length("content") > threshold, file_skeleton_id(F.col("path")))
    return parsed.where("parse_error is null").withColumn("file_id", file_id).withColumn("budget", F.lit(budget))


def _struct(columns: dict[str, Column], wanted: Sequence[str] | None) -> Column:
    return F.struct(*(columns[c].alias(c) for c in (columns if wanted is None else wanted)))


def chunks(annotated: DataFrame, columns: Sequence[str] | None = None, kinds: Sequence[str] = KINDS) -> DataFrame:
    """One row a chunk, ``ord`` being its place in the file (the file's overview is first, at -1); without references.

    Of the given kinds and with the given columns only: what isn't asked for, like texts, isn't made.
    """
    path, budget = F.col("path"), F.col("budget")

    def is_kept(d: Column) -> Column:
        return (_size(d) <= budget) | (d["nested"] == 0)

    def wanted(d: Column) -> Column:
        whole, cut = schema.DEFINITION in kinds, schema.DEFINITION_SKELETON in kinds
        return _emitted(d, budget) & (F.lit(True) if whole and cut else is_kept(d) if whole else ~is_kept(d))

    def of(d: Column, content: Column) -> Column:
        at, kept = d["id"], is_kept(d)
        code = F.when(kept, byte_text(content, d["start"], d["end"])).otherwise(_skeleton(d))
        # by place: a slice would copy all definitions of the file for each of them
        inside = F.when(kept & (d["nested"] > 0), F.sequence(at + 1, at + d["nested"]))
        folded = F.coalesce(F.transform(inside, lambda i: _name(F.get("defs", i))), F.array().cast("array<string>"))
        return _struct(
            {
                "chunk_id": _id(d),
                "full_name": _name(d),
                "name": d["name"],
                "file_path": path,
                "start_byte": d["start"],
                "end_byte": d["end"],
                "start_line": d["start_line"],
                "end_line": d["end_line"],
                "language": F.col("language"),
                "code": code,
                "defined_in_class": d["enclosing_class"],
                "node_type": d["type"],
                "kind": F.when(kept, schema.DEFINITION).otherwise(schema.DEFINITION_SKELETON),
                "size_chars": F.length(code),
                "parent_chunk_id": F.when(d["parent"] >= 0, _id(_parent(d))).otherwise(F.col("file_id")),
                "contained_symbols": folded,
                "ord": at,
            },
            columns,
        )

    overview = F.array_join(F.concat(F.array(F.concat(F.lit("# file: "), path)), _lines(F.col("root"), "")), "\n")
    none = F.lit(None).cast("string")
    file_chunk = _struct(
        {
            "chunk_id": F.col("file_id"),
            "full_name": path,
            "name": last_segment(path),
            "file_path": path,
            "start_byte": F.lit(0),
            "end_byte": F.lit(0),
            "start_line": F.col("start_line"),
            "end_line": F.col("end_line"),
            "language": F.col("language"),
            "code": overview,
            "defined_in_class": none,
            "node_type": none,
            "kind": F.lit(schema.FILE_SKELETON),
            "size_chars": F.length(overview),
            "parent_chunk_id": none,
            "contained_symbols": F.array().cast("array<string>"),
            "ord": F.lit(-1),
        },
        columns,
    )
    parts = []
    if schema.FILE_SKELETON in kinds:
        parts.append(F.coalesce(F.when(F.col("file_id").isNotNull(), F.array(file_chunk)), F.slice(F.array(file_chunk), 1, 0)))
    if schema.DEFINITION in kinds or schema.DEFINITION_SKELETON in kinds:
        parts.append(once(F.col("content"), lambda content: F.transform(F.filter("defs", wanted), lambda d: of(d, content))))
    return annotated.select(F.inline(F.concat(*parts)))


def refs(annotated: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row a reference with the chunk that owns it: the innermost definition around it that is one, or the file's overview.

    A reference outside of all definitions of a file without overview has no owner and is dropped.
    Columns that aren't asked for aren't made.  ``self_class`` is what ``self`` and the like stand for, null for texts that don't begin so.
    """

    def of(r: Column) -> Column:
        inner = F.get("defs", r["def"])
        owner = F.get(F.filter(inner["ancestors"], lambda a: _emitted(F.get("defs", a), F.col("budget"))), F.lit(0))
        d = F.get("defs", owner)
        return _struct(
            {
                "file_path": F.col("path"),
                "ord": r["ord"],
                "chunk_id": F.when(r["def"] >= 0, _id(d)).otherwise(F.col("file_id")),
                "chunk_ord": F.when(r["def"] >= 0, owner).otherwise(-1),
                "chunk_name": F.when(r["def"] >= 0, d["name"]).otherwise(last_segment(F.col("path"))),
                "language": F.col("language"),
                "self_class": F.when((r["def"] >= 0) & _begins_with_self(r["text"]), F.coalesce(F.when(d["enclosing_class"] != "", d["enclosing_class"]), _name(d))),
                "text": r["text"],
                "kind": r["kind"],
                "start_byte": r["start"],
                "end_byte": r["end"],
            },
            columns,
        )

    owned = F.when(F.col("file_id").isNotNull(), F.col("raw_refs")).otherwise(F.filter("raw_refs", lambda r: r["def"] >= 0))
    return annotated.select(F.inline(F.transform(owned, of)))


def _begins_with_self(text: Column) -> Column:
    """Whether a text may begin with a name for the class around it: those are prefixes of it, at least."""
    return reduce(or_, (F.startswith(text, F.lit(name)) for name in sorted({name for language in REGISTRY for name in language.self_names})))


def import_metadata(annotated: DataFrame) -> DataFrame:
    """(file_path, import_text, import_ranges): the import statements in document order."""
    statements = F.array_sort(F.array_distinct(F.transform("raw_imports", lambda i: F.struct(i["start"].alias("start"), i["end"].alias("end")))))
    text = once(F.col("content"), lambda content: F.array_join(F.transform(statements, lambda s: byte_text(content, s["start"], s["end"])), "\n"))
    return annotated.select(F.col("path").alias("file_path"), text.alias("import_text"), statements.alias("import_ranges"))
