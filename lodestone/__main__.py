"""``python -m lodestone ROOT``: ingest a repository and print its report."""

import sys

from pyspark.sql import SparkSession

from .plans.repository import chunk_repository

if __name__ == "__main__":
    repository = chunk_repository(SparkSession.builder.appName("lodestone").getOrCreate(), sys.argv[1] if len(sys.argv) > 1 else ".")
    repository.log_skipped()
    repository.show_report()
