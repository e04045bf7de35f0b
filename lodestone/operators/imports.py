"""Import bindings: which file and name a local name stands for.

Paths are tested against the whole listing of the repository, not against the files that were
accepted: an import of a skipped file has a path, though no symbols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.columns import join_module, strip_quotes
from ..languages import REGISTRY


def _by_language(value) -> Column:
    """A column that has for each language what ``value`` says of it."""
    out = F.lit(None)
    for language in REGISTRY:
        out = F.when(F.col("language") == language.name, F.lit(value(language))).otherwise(out)
    return out


def _with_suffix(path: Column, suffix: Column) -> Column:
    """The path with its last name's suffix replaced, or added."""
    return F.concat(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""), suffix)


def _clean(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"/(?:\./)+", "/"), "(?<=.)/+", "/"), r"^(?:\./)+(?=.)", "")


def _parent(path: Column, levels: Column) -> Column:
    """The path without its last ``levels`` names."""
    parts = F.split(path, "/", -1)
    kept = F.greatest(F.size(parts) - levels, F.lit(0))
    joined = F.array_join(F.slice(parts, 1, kept), "/")
    return F.when(joined != "", joined).when(F.startswith(path, F.lit("/")), "").otherwise(".")


def candidates(module: Column, relative: Column, file_path: Column, root: Column) -> Column:
    """Paths that a module may have, in the order of trying them; empty where the language resolves none."""
    text = strip_quotes(module)
    dotted = _by_language(lambda x: x.dotted_modules)
    extension, index = _by_language(lambda x: x.extension), _by_language(lambda x: x.index_file)
    dots = F.length(F.regexp_extract(text, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(text, r"^\.+", ""), F.lit("."), F.lit("/"))
    near = F.when(rest == "", _parent(file_path, dots)).otherwise(F.concat_ws("/", _parent(file_path, dots), rest))
    near_paths = F.array_compact(F.array(F.when(rest != "", _with_suffix(near, extension)), F.concat(near, F.lit("/"), index)))
    segment = F.when(dotted, F.replace(text, F.lit("."), F.lit("/"))).otherwise(text)
    far = F.when(F.startswith(segment, F.lit("/")), segment).otherwise(F.when(root == ".", segment).otherwise(F.concat(root, F.lit("/"), segment)))
    far_paths = F.array_compact(F.array(_with_suffix(far, extension), F.concat(far, F.lit("/"), index)))
    none = F.array().cast("array<string>")
    paths = F.when(relative, F.when(_by_language(lambda x: x.relative_imports), near_paths).otherwise(none)).otherwise(
        F.when(_by_language(lambda x: x.directories), none).otherwise(far_paths)
    )
    return F.transform(paths, _clean)


def statements(annotated: DataFrame) -> DataFrame:
    """One row a bound name or wildcard; of aliases of one name in a statement the last stays."""
    last = F.filter(
        "raw_imports",
        lambda i: ~F.exists("raw_imports", lambda j: (j["form"] == "named") & (i["form"] == "named") & (j["stmt"] == i["stmt"]) & (j["bound"] == i["bound"]) & (j["ord"] > i["ord"])),
    )
    return annotated.select(F.col("path").alias("file_path"), "language", F.inline(last)).where("form <> 'none'")


def resolve(statements_: DataFrame, listing: DataFrame, root: str) -> DataFrame:
    """Adds ``resolved_path`` (null: outside of the repository) and ``kind`` to each statement row."""
    where = F.lit(root)
    module, relative, path = F.col("module"), F.col("relative"), F.col("file_path")
    own = candidates(module, relative, path, where)
    below = F.when((F.col("form") == "named") & _by_language(lambda x: x.submodules), candidates(join_module(module, F.col("bound")), relative, path, where))
    tried = F.concat(
        F.transform(F.coalesce(below, F.array().cast("array<string>")), lambda p: F.struct(F.lit(schema.MODULE).alias("kind"), p.alias("path"))),
        F.transform(own, lambda p: F.struct(F.when(F.col("form") == "named", schema.NAMED).otherwise(schema.MODULE).alias("kind"), p.alias("path"))),
    )
    key = ["file_path", "ord"]
    rows = statements_.withColumn("tried", tried)
    probes = rows.select(*key, F.posexplode("tried").alias("rank", "try")).select(*key, "rank", "try.kind", "try.path")
    there = listing.select("path").distinct()
    found = probes.join(there, "path").groupBy(*key).agg(F.min(F.struct("rank", "path", "kind")).alias("hit"))
    fallback = F.when(F.col("form") == "named", schema.NAMED).otherwise(schema.MODULE)
    return rows.drop("tried").join(found, key, "left").withColumn("resolved_path", F.col("hit.path")).withColumn("kind", F.coalesce("hit.kind", fallback)).drop("hit")


def bindings(resolved: DataFrame) -> DataFrame:
    """(file_path, local_name, resolved_path, remote_name, kind, extra_segments): of bindings of one name the last stays."""
    named = resolved.where("form <> 'wildcard'")
    value = F.struct("resolved_path", F.when(F.col("form") == "direct", F.col("alias")).otherwise(F.col("bound")).alias("remote_name"), "kind", F.col("extra").alias("extra_segments"))
    return named.groupBy("file_path", F.col("alias").alias("local_name")).agg(F.max_by(value, "ord").alias("v")).select("file_path", "local_name", "v.*")


def wildcards(resolved: DataFrame) -> DataFrame:
    """(file_path, modules): files of wildcard imports in document order, those that have a path."""
    hits = resolved.where("form = 'wildcard' and resolved_path is not null")
    return hits.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "resolved_path"))), lambda x: x["resolved_path"]).alias("modules"))
