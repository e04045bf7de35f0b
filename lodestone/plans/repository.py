"""From a repository to its tables.

Scan, validate, parse and chunk are narrow: a file is one row from its bytes to its chunks.
Names are what shuffles: bindings and references meet the listing and the symbol index by keys.
"""

from __future__ import annotations

import logging
from collections.abc import Collection
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import and_

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema, settings
from ..functions.validation import skip_reason
from ..operators import chunks as C
from ..operators import imports as I
from ..operators import report, symbols
from ..operators.parse import language_of, parse
from ..operators.resolve import NAME, resolve
from ..sources.repository import normal_root, read_files, read_listing


@dataclass
class Repository:
    """The tables of a repository; all lazy but for the parsed files, which are kept once they are read."""

    checked: DataFrame
    parsed: DataFrame
    annotated: DataFrame
    listing: DataFrame
    root: str

    @cached_property
    def files(self) -> DataFrame:
        return C.import_metadata(self.annotated)

    @cached_property
    def skipped(self) -> DataFrame:
        """(file_path, reason): files that validation or a front end turned down."""
        early = self.checked.where("reason is not null").select(F.col("path").alias("file_path"), "reason")
        return early.unionByName(self.parsed.where("parse_error is not null").select(F.col("path").alias("file_path"), F.col("parse_error").alias("reason")))

    @cached_property
    def plain_chunks(self) -> DataFrame:
        return C.chunks(self.annotated)

    def some_chunks(self, *columns: str, kinds: tuple[str, ...] = C.KINDS) -> DataFrame:
        """Chunks of the given kinds with the given columns."""
        return C.chunks(self.annotated, columns, kinds)

    @cached_property
    def symbols(self) -> DataFrame:
        return symbols.symbol_index(self.some_chunks(*symbols.COLUMNS, kinds=(schema.DEFINITION, schema.DEFINITION_SKELETON)))

    def known_names(self) -> DataFrame:
        """The names of ``symbols``, without ids."""
        return symbols.known_names(self.some_chunks(*symbols.NAMED, kinds=(schema.DEFINITION, schema.DEFINITION_SKELETON)))

    @cached_property
    def resolved_imports(self) -> DataFrame:
        return I.resolve(I.statements(self.annotated), self.listing, self.root)

    @cached_property
    def import_bindings(self) -> DataFrame:
        return I.bindings(self.resolved_imports)

    @cached_property
    def wildcards(self) -> DataFrame:
        return I.wildcards(self.resolved_imports)

    def counted_names(self, *columns: str) -> DataFrame:
        """Distinct references by NAME and the given columns, of few values each, with their number ``n``, target and status."""
        counted = C.refs(self.annotated, (*NAME, *columns)).groupBy(*NAME, *columns).agg(F.count("*").alias("n"))
        if not columns:
            return self._resolved(counted)
        names = counted.groupBy(*NAME).agg(F.collect_list(F.struct(*columns, "n")).alias("each"))
        return self._resolved(names).select(*NAME, "points_to", "status", F.inline("each"))

    def some_refs(self, *columns: str) -> DataFrame:
        """References with the given columns, target and status."""
        names = self._resolved(C.refs(self.annotated, NAME).distinct()).select(*(F.col(c).alias(f"__{c}") for c in NAME), "points_to", "status")
        rows = C.refs(self.annotated, tuple(dict.fromkeys((*columns, *NAME))))
        return rows.join(names, reduce(and_, (rows[c].eqNullSafe(names[f"__{c}"]) for c in NAME))).select(*columns, "points_to", "status")

    def _resolved(self, names: DataFrame) -> DataFrame:
        return resolve(names, self.symbols, self.import_bindings, self.wildcards)

    @cached_property
    def refs(self) -> DataFrame:
        """References with their chunk, target and status."""
        return self.some_refs(*C.refs(self.annotated).columns)

    @cached_property
    def chunks(self) -> DataFrame:
        """Chunks with their references inside, in order."""
        ref = F.struct("ord", "text", "kind", "points_to", "start_byte", "end_byte", "status")
        grouped = self.refs.groupBy("file_path", "chunk_id").agg(F.array_sort(F.collect_list(ref)).alias("references"))
        rows = self.plain_chunks.join(grouped, ["file_path", "chunk_id"], "left")
        clean = F.transform("references", lambda r: r.dropFields("ord"))
        kind = "array<struct<text:string,kind:string,points_to:string,start_byte:int,end_byte:int,status:string>>"
        return rows.withColumn("references", F.coalesce(clean.cast(kind), F.array().cast(kind)))

    @cached_property
    def file_rows(self) -> DataFrame:
        """One row a file, everything nested in it."""
        from ..schema import CHUNK_COLUMNS

        nested = self.chunks.groupBy("file_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.struct(*CHUNK_COLUMNS).alias("c")))), lambda x: x["c"]).alias("chunks"))
        entry = F.struct("local_name", F.struct("local_name", "resolved_path", "remote_name", "kind", "extra_segments"))
        bound = self.import_bindings.groupBy("file_path").agg(F.map_from_entries(F.collect_list(entry)).alias("import_bindings"))
        wild = self.wildcards.withColumnRenamed("modules", "wildcard_import_modules")
        return self.files.join(nested, "file_path", "left").join(bound, "file_path", "left").join(wild, "file_path", "left")

    def totals(self) -> DataFrame:
        return report.totals(self.files, self.some_chunks("ord"), self.counted_names())

    def skip_counts(self) -> DataFrame:
        return report.skip_counts(self.skipped)

    def log_skipped(self) -> None:
        """One warning with the number of skipped files by reason."""
        if counts := {r["reason"]: r["n"] for r in self.skip_counts().collect()}:
            logging.getLogger(__name__).warning("skipped %d files: %s", sum(counts.values()), ", ".join(f"{k}={v}" for k, v in sorted(counts.items())))

    def show_report(self) -> None:
        self.totals().show(truncate=False)
        report.sample(self.refs, "local", 10).show(10, truncate=False)
        report.sample(self.refs, "unresolved", 20).show(20, truncate=False)
        suspicious = report.suspicious(self.refs, self.plain_chunks)
        print(f"{suspicious.count()} suspicious unresolved references")  # noqa: T201
        for row in suspicious.toLocalIterator():  # all of them, a partition at a time
            print(*row, sep="\t")  # noqa: T201


def ingest(
    files: DataFrame,
    listing: DataFrame,
    root: str = ".",
    max_size_mb: float = settings.MAX_FILE_SIZE_MB,
    skeleton_threshold: int = settings.FILE_SKELETON_THRESHOLD,
    budget: int = settings.DEFINITION_BUDGET,
    only: Collection[str] | None = None,
) -> Repository:
    """The tables of files (path, length, content, error) of one repository, wherever they come from.

    ``only`` names the lists of a parsed file that a single table is made of: the others are left out, and parsed files aren't kept.
    """
    C.check_budgets(budget, skeleton_threshold)
    language = F.coalesce(language_of(F.col("path")), F.lit(""))
    reason = skip_reason(F.col("path"), F.col("length"), F.col("content"), F.col("error"), max_size_mb)
    checked = files.withColumn("language", language).withColumn("reason", F.coalesce(reason, F.when(F.col("language") == "", "UnsupportedFileExtensionError")))
    accepted = checked.where("reason is null")
    parsed = parse(accepted).persist(StorageLevel.MEMORY_AND_DISK) if only is None else parse(accepted, tuple(only))
    return Repository(checked, parsed, C.annotate(parsed, budget, skeleton_threshold), listing, normal_root(root))


def chunk_repository(
    spark: SparkSession, root: str, max_size_mb: float = settings.MAX_FILE_SIZE_MB, skeleton_threshold: int = settings.FILE_SKELETON_THRESHOLD, budget: int = settings.DEFINITION_BUDGET
) -> Repository:
    """The tables of the repository at ``root``."""
    C.check_budgets(budget, skeleton_threshold)
    return ingest(read_files(spark, root, max_size_mb), read_listing(spark, root), root, max_size_mb, skeleton_threshold, budget)
