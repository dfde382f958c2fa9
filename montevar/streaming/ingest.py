"""Incremental ingest of per-symbol price files with Structured Streaming.

New ``<symbol>.csv`` files dropped into a folder are parsed with the same native
expressions as the batch reader and appended to a Parquet price table.

The stream's progress lies below the table it fills, one folder for each source, so it is found again by
any later session and sources do not share it.  Every batch is written to a partition folder of its own
(``source=<digest>/batch=<number>``) which a repeated batch overwrites: each file is in the table exactly once across
restarts.  ``availableNow`` processes what is there and stops, which suits a daily batch cadence.
Duplicate observations are left to ``operators.series.dedup_series`` at read time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from montevar.functions.parsing import STOCK_DATE
from montevar.sources.files import (CORRUPT, STOCK_COLUMNS, _string_schema, checked_prices, good_rows, parse_prices, rejected_rows,
                                    symbol_of_file)


def price_file_stream(spark: SparkSession, directory: str, date_format: str = STOCK_DATE,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming DataFrame of typed price rows from a folder of ``<symbol>.csv`` files."""
    reader = spark.readStream.schema(_string_schema(STOCK_COLUMNS)).option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.csv(directory.rstrip("/") + "/*.csv")
    return parse_prices(raw.select(*STOCK_COLUMNS, symbol_of_file().alias("symbol")), date_format)


def checked_file_stream(spark: SparkSession, directory: str, date_format: str = STOCK_DATE) -> DataFrame:
    """Streaming ``sources.files.checked_prices`` of a folder: every landed row, good or refused."""
    raw = (spark.readStream.schema(_string_schema([*STOCK_COLUMNS, CORRUPT])).option("header", True).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).csv(directory.rstrip("/") + "/*.csv"))
    return checked_prices(raw.select(*STOCK_COLUMNS, CORRUPT, symbol_of_file().alias("symbol"),
                                     F.col("_metadata.file_name").alias("file")), date_format)


def ingest_prices(spark: SparkSession, source_dir: str, table_dir: str, checkpoint_location: str | None = None,
                  available_now: bool = True, rejects_dir: str | None = None) -> StreamingQuery:
    """Start (and with ``available_now`` run to completion) the ingest of one folder into ``table_dir``.

    With ``rejects_dir``, lines with a wrong number of fields or without a date go there with their file and reason, as
    often as they occur; without it rows without a date are dropped and short lines are filled with NULLs.

    Progress lies in ``<table_dir>/_progress/<source>`` (readers skip names with an underscore)
    unless a location is given; a location must not be shared by two sources.
    """
    source, table = source_dir.rstrip("/"), table_dir.rstrip("/")
    digest = hashlib.sha256(source.encode()).hexdigest()[:16]
    progress = checkpoint_location or f"{table}/_progress/{digest}"

    def append(batch: DataFrame, number: int) -> None:
        place = f"source={digest}/batch={number}"
        if rejects_dir is None:
            batch.write.mode("overwrite").parquet(f"{table}/{place}")
            return
        rejected_rows(batch).write.mode("overwrite").parquet(f"{rejects_dir.rstrip('/')}/{place}")
        good_rows(batch).drop("file", "nulled").write.mode("overwrite").parquet(f"{table}/{place}")

    stream = price_file_stream(spark, source) if rejects_dir is None else checked_file_stream(spark, source)
    writer = (stream.writeStream.foreachBatch(append)
              .option("checkpointLocation", progress).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def read_prices(spark: SparkSession, table_dir: str) -> DataFrame:
    """The ingested table without the partition columns."""
    return spark.read.parquet(table_dir).drop("source", "batch")
