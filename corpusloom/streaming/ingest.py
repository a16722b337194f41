"""Continuous chunking of text files that arrive in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.plans.api import split_text
from corpusloom.plans.options import ChunkOptions


def chunk_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, options: ChunkOptions = ChunkOptions()) -> StreamingQuery:
    """Chunk each new file once into Parquet below ``sink``; chunking needs nothing of other documents, so the stream has no state.

    A batch is written to a folder of its own, which a repeated batch replaces.
    """
    files = spark.readStream.format("text").option("wholetext", "true").load(source)
    docs = files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))

    def write(batch: DataFrame, number: int) -> None:
        split_text(batch, options).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
