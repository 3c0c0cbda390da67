"""Writing a stream as pages, and sums over a stream."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.delta import streaming_sum
from ..sources import columns


def page_writer(path: str, col: str, *keys: str, **how):
    """A foreachBatch function: each batch becomes chunks of its own below
    ``path/batch=<number>``. A batch that is run again overwrites its folder, so
    every number is there once."""

    def write(batch: DataFrame, number: int) -> None:
        columns.compress(batch, col, *keys, **how).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def write_stream(stream: DataFrame, path: str, checkpoint: str, col: str, *keys: str, **how) -> StreamingQuery:
    """Compress a stream chunk by chunk while it arrives."""
    writer = stream.writeStream.foreachBatch(page_writer(path, col, *keys, **how))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_batches(spark, path: str, ntype: str) -> DataFrame:
    """(batch, pos, x) of what write_stream has written: one scan, however many
    batches there are."""
    pages = spark.read.parquet(path).withColumn("batch", F.col("batch").cast("long"))
    return columns.decompress(pages, ntype, also="batch")


def running_sum(stream: DataFrame, col: str) -> DataFrame:
    """Sum and count over a stream, for complete mode."""
    return streaming_sum(stream, col)
