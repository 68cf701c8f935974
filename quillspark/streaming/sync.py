"""Chunks that arrive as files, brought into the index batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..operators import index
from ..sources.files import CHUNK


def stream_chunks(spark: SparkSession, folder: str, schema=CHUNK, fmt: str = "json", files_per_batch: int = 100) -> DataFrame:
    """The files of a folder as a stream of chunks."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)


def upsert(spark: SparkSession, root: str, batch: DataFrame, embed, key: str = "chunk_id") -> dict[str, int]:
    """Add or replace the chunks of a batch in the index below root; others stay. Of a key that the batch
    repeats, the row of the greatest text is taken."""
    one = batch.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.desc_nulls_last("text")))).where("__n = 1").drop("__n")
    return index.upsert(spark, root, one, embed, key)


def run(chunks: DataFrame, root: str, embed, checkpoint: str, once: bool = True):
    """Start the stream: every batch is an upsert that writes the batch's changes only."""

    def batch(df: DataFrame, n: int) -> None:
        df.persist()  # read for the differences and for the rows
        try:
            upsert(df.sparkSession, root, df, embed)
        finally:
            df.unpersist()

    w = chunks.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()
