"""Continuous ingestion of chunk files: a file stream whose batches are appended once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.sources.store import Collection


def chunk_stream(spark: SparkSession, folder: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", 64).load(folder)


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, key: str = "chunk_id") -> StreamingQuery:
    """Appends every micro-batch idempotently: a batch that is repeated after a failure finds its keys present."""

    def add(batch: DataFrame, _: int) -> None:
        collection.append(batch, key)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
