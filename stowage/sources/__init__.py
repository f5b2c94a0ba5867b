"""Data sources: `register` makes them known to a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .archive_sink import ArchiveSink
from .tree import TreeSource


def register(spark: SparkSession) -> None:
    for source in (TreeSource, ArchiveSink):
        spark.dataSource.register(source)
