"""A repository on disk as DataFrames: its source files, and everything that lies in it.

Spark's own file sources leave out names that start with an underscore or a dot, and with
them ``__init__.py``.  This source lists directories itself, prunes them before descending, and
deals files out over tasks by size.  Files that are empty or too large aren't read.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import schema
from ..languages import BY_EXTENSION
from ..settings import MAX_FILE_SIZE_MB, SKIP_DIRS

#: Bytes of files that one task reads, about.
_TASK_BYTES = 32 << 20
_TASK_FILES = 5000
#: Folders from which on a listing isn't split further, and levels down to which it is at most.
_LISTING_TASKS, _UPPER_LEVELS = 64, 4


def normal_root(root: str) -> str:
    """The root as all paths begin with it; resolved imports and scanned files must agree in it."""
    return posixpath.normpath(root.replace(os.sep, "/"))


def source_files(root: str, extensions: frozenset[str]) -> Iterator[str]:
    """Paths of source files below the root, without skipped and hidden directories."""
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in SKIP_DIRS and not d.startswith("."))
        for name in sorted(names):
            if os.path.splitext(name)[1] in extensions:
                yield posixpath.join(folder, name)


class _Group(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _FileReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = normal_root(options["path"])
        self.most = float(options.get("maxsizemb", MAX_FILE_SIZE_MB)) * 1024 * 1024
        self.extensions = frozenset(options.get("extensions", ",".join(BY_EXTENSION)).split(","))

    def partitions(self) -> list[InputPartition]:
        groups: list[list[str]] = [[]]
        size = 0
        for path in source_files(self.root, self.extensions):
            try:
                bytes_ = os.path.getsize(path)
            except OSError:
                bytes_ = 0
            if groups[-1] and (size + bytes_ > _TASK_BYTES or len(groups[-1]) >= _TASK_FILES):
                groups.append([])
                size = 0
            groups[-1].append(path)
            size += bytes_
        return [_Group(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            length = None
            try:
                length, content = os.path.getsize(path), None
                if 0 < length <= self.most:
                    with open(path, "rb") as f:
                        content = f.read()
                yield path, length, content, None
            except OSError as error:
                yield path, length, None, type(error).__name__ if length is not None else "FileAccessError"


class RepositoryFiles(DataSource):
    """``spark.read.format("repository_files").load(root)``: path, length, content, error of every source file.

    Options: ``maxSizeMb`` (larger files keep a null content), ``extensions`` (comma-separated).
    """

    @classmethod
    def name(cls) -> str:
        return "repository_files"

    def schema(self) -> str:
        return schema.FILES

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _FileReader(self.options)


class _Folders(InputPartition):
    def __init__(self, paths: list[str], deep: bool) -> None:
        self.paths, self.deep = paths, deep


class _ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = normal_root(options["path"])

    def partitions(self) -> list[InputPartition]:
        """The upper folders are listed by one task; each folder below them has a task, with all that is in it."""
        upper, lower = [], [self.root]
        for _ in range(_UPPER_LEVELS):
            if len(lower) >= _LISTING_TASKS:
                break
            upper += lower
            lower = [d for folder in lower for d in _subfolders(folder)]
        return [_Folders(upper, False), *(_Folders([f], True) for f in lower)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for top in partition.paths:
            for folder, folders, names in os.walk(top):
                yield folder, True, None
                for name in names + [d for d in folders if os.path.islink(os.path.join(folder, d))]:
                    path = posixpath.join(folder, name)
                    try:
                        regular = os.path.isfile(path) and not os.path.islink(path)
                        yield path, os.path.isdir(path), os.path.getsize(path) if regular else None
                    except OSError:
                        continue
                if not partition.deep:
                    break


def _subfolders(folder: str) -> list[str]:
    try:
        with os.scandir(folder) as entries:
            return sorted(posixpath.join(folder, e.name) for e in entries if e.is_dir(follow_symlinks=False))
    except OSError:
        return []


class RepositoryListing(DataSource):
    """``spark.read.format("repository_listing").load(root)``: everything below the root, nothing pruned.

    ``length`` is null for directories and links, so its sum is the size of the repository.
    """

    @classmethod
    def name(cls) -> str:
        return "repository_listing"

    def schema(self) -> str:
        return schema.LISTING

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _ListingReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RepositoryFiles)
    spark.dataSource.register(RepositoryListing)


def read_files(spark: SparkSession, root: str, max_size_mb: float = MAX_FILE_SIZE_MB) -> DataFrame:
    register(spark)
    return spark.read.format("repository_files").option("maxSizeMb", max_size_mb).load(normal_root(root))


def read_listing(spark: SparkSession, root: str) -> DataFrame:
    register(spark)
    return spark.read.format("repository_listing").load(normal_root(root))
