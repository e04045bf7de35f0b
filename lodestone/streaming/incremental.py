"""Re-indexing as files change: a stream of file versions to the chunks of the newest version of each.

Chunk ids don't change while a definition keeps its file, place and name, so downstream tables can be
merged by id.  Every micro-batch is written under its own number and overwritten if it is
run again, so a restart after a failure gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import settings
from ..plans.repository import ingest


def start(
    versions: DataFrame, out: str, checkpoint: str, budget: int = settings.DEFINITION_BUDGET, skeleton_threshold: int = settings.FILE_SKELETON_THRESHOLD, available_now: bool = False
) -> StreamingQuery:
    """Indexes a stream of (path, length, content, error, version); the highest version of a path in a batch counts."""

    def index(batch: DataFrame, number: int) -> None:
        newest = batch.groupBy("path").agg(F.max_by(F.struct("length", "content", "error", "version"), "version").alias("v")).select("path", "v.*")
        newest = newest.persist()
        files = newest.drop("version")
        r = ingest(files, files.select("path"), ".", skeleton_threshold=skeleton_threshold, budget=budget)
        r.plain_chunks.write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        newest.select("path", "version").write.mode("overwrite").parquet(f"{out}/files/batch={number}")
        r.parsed.unpersist()
        newest.unpersist()

    writer = versions.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_chunks(spark: SparkSession, out: str) -> DataFrame:
    """Chunks of the newest version of each file; a file that is empty or broken now has none."""
    files = spark.read.parquet(f"{out}/files")
    last = files.groupBy("path").agg(F.max_by("batch", F.struct("version", "batch")).alias("batch"))
    chunks = spark.read.parquet(f"{out}/chunks")
    return chunks.join(last, (chunks["file_path"] == last["path"]) & (chunks["batch"] == last["batch"]), "left_semi")
