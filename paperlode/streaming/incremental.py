"""Chunks of new documents only: a file stream that remembers what it has read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from paperlode.operators import chunking


def chunk_new(spark: SparkSession, documents: str, chunks: str, checkpoint: str, schema: str = "doc_id string, domain string, title string, text string") -> StreamingQuery:
    """Chunk the documents under a folder that earlier calls have not seen, append them, and stop.

    The checkpoint holds what is done, so a call after a failure goes on where the last one stopped; each batch is
    written under its number, so a repeated batch replaces itself.
    """

    def write(batch: DataFrame, number: int) -> None:
        chunking.chunk(chunking.documents(batch)).write.mode("overwrite").parquet(f"{chunks}/batch={number}")

    new = spark.readStream.schema(schema).parquet(documents)
    return new.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
