"""Resolving names: one explode, one equi-join, one aggregation.

What a reference means depends on its file, its text and, if that begins with ``self``, its class: on
NAME.  A module refers to the same name over and over, so names are resolved, not references.
Every name lists the (file, name) pairs that it may mean, in order; the first that the symbol
index knows wins.  A binding to something outside of the repository ends the search where it stands
in the order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.columns import clean_parts
from ..languages import REGISTRY
from .symbols import FULL, SIMPLE

#: Columns on which the target of a reference depends.
NAME = ("file_path", "language", "text", "self_class")
_CANDIDATE = "array<struct<step:int,place:int,tbl:string,path:string,q:string>>"


def _candidate(step: int, place: Column, path: Column, q: Column, tbl: str = FULL) -> Column:
    return F.struct(F.lit(step).alias("step"), place.cast("int").alias("place"), F.lit(tbl).alias("tbl"), path.alias("path"), q.alias("q"))


def _prefixes(step: int, path: Column, head: Column | None, parts: Column, least: int) -> Column:
    """Candidates head + parts[:i] for i from all parts down to ``least``."""
    count = F.size(parts)

    def one(i: Column) -> Column:
        some = F.array_join(F.slice(parts, 1, i), ".")
        name = some if head is None else F.when(i > 0, F.concat(head, F.lit("."), some)).otherwise(head)
        return _candidate(step, count - i, path, name)

    return F.when(count >= least, F.transform(F.sequence(count, F.lit(least), F.lit(-1)), one))


def _some(language_value) -> Column:
    out = F.lit(False)
    for language in REGISTRY:
        if members := sorted(language_value(language)):
            out = out | ((F.col("language") == language.name) & F.col("__first").isin(members))
    return out


def candidates() -> Column:
    """Ordered candidates of a row with text, its parts, its binding and its file's wildcard modules."""
    parts, first, path = F.col("__parts"), F.col("__first"), F.col("file_path")
    inside, remote = F.col("resolved_path").isNotNull(), F.col("remote_name")
    none = F.array().cast(_CANDIDATE)
    own = F.when(_some(lambda x: x.self_names) & F.col("self_class").isNotNull(), _prefixes(1, path, F.col("self_class"), F.slice(parts, 2, F.size(parts)), 0))
    local = _prefixes(2, path, None, parts, 1)
    skip = F.coalesce(F.col("extra_segments"), F.lit(0)) + 2
    rest = F.slice(parts, skip, F.size(parts))
    module = F.when(inside & (F.col("binding") == schema.MODULE), _prefixes(3, F.col("resolved_path"), None, rest, 1))
    named = F.when(inside & (F.col("binding") == schema.NAMED), _prefixes(3, F.col("resolved_path"), remote, rest, 0))
    empty = lambda c: F.coalesce(c.cast(_CANDIDATE), none)
    dotted = F.concat(empty(own), empty(local), empty(module), empty(named))
    external = F.col("binding").isNotNull() & ~inside
    wild = F.transform(F.coalesce("modules", F.array().cast("array<string>")), lambda m, i: _candidate(4, i, m, first))
    bare = F.concat(
        F.array(_candidate(1, F.lit(0), path, first), _candidate(2, F.lit(0), path, first, SIMPLE)).cast(_CANDIDATE),
        empty(F.when(inside, F.array(_candidate(3, F.lit(0), F.col("resolved_path"), remote)))),
        F.when(external, none).otherwise(empty(wild)),
    )
    return F.when(F.col("__dotted"), dotted).otherwise(bare)


def resolve(names: DataFrame, symbols: DataFrame, bindings: DataFrame, wildcards: DataFrame) -> DataFrame:
    """Adds ``points_to`` and ``status`` to each name; what NAME has tells names apart."""
    bound = bindings.select("file_path", F.col("local_name").alias("__first"), "resolved_path", "remote_name", F.col("kind").alias("binding"), "extra_segments")
    rows = (
        names.withColumn("__dotted", F.contains("text", F.lit(".")))
        .withColumn("__parts", clean_parts(F.col("text")))
        .withColumn("__first", F.get("__parts", F.lit(0)))
        .join(bound, ["file_path", "__first"], "left")
        .join(wildcards, "file_path", "left")
    )
    kept = [c for c in names.columns if c not in NAME]
    probes = rows.select("*", F.explode(candidates()).alias("c"))
    hits = probes.join(symbols.withColumnRenamed("chunk_id", "hit"), (F.col("c.tbl") == F.col("tbl")) & (F.col("c.path") == F.col("path")) & (F.col("c.q") == F.col("q")), "left")
    builtin = ~F.col("__dotted") & _some(lambda x: x.builtins)
    ended = F.when(F.col("binding").isNotNull() & F.col("resolved_path").isNull(), schema.EXTERNAL).when(builtin, schema.BUILTIN).otherwise(schema.UNRESOLVED)
    found = hits.groupBy(*NAME).agg(
        F.min(F.when(F.col("hit").isNotNull(), F.struct("c.step", "c.place", "hit"))).alias("best"),
        F.first(F.struct(*kept, ended.alias("ended"))).alias("ref"),
    )
    return found.select(*NAME, *(f"ref.{c}" for c in kept), F.col("best.hit").alias("points_to"), F.when(F.col("best").isNotNull(), schema.LOCAL).otherwise(F.col("ref.ended")).alias("status"))
