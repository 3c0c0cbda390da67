"""Positions, chunks, pages and batches.

A sequence is a table with a unique ordering key. Positions are given without a
single-task sort: the rows are range-partitioned and sorted, each partition is
counted, and a row's position is its place in its partition plus the rows of all
partitions before it. Everything after that is partitioned by chunk."""
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch

CHUNK_N, PAGE_N, BATCH_N = 1 << 18, 1 << 18, 256
_ROW_BITS = 33


def with_position(df: DataFrame, *keys: str, name: str = "pos") -> DataFrame:
    """df with 0-based positions by the keys, which must be unique together.
    The sorted rows are written once, so positions are the same on every read;
    the offsets are one number for each partition, and broadcast."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_ = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__id", id_)
    kept = Scratch(spark, "sequence").keep(ordered, "ordered")
    part = F.shiftright("__id", _ROW_BITS)
    sizes = {r["p"]: r["n"] for r in kept.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = dict(zip(sorted(sizes), accumulate((sizes[p] for p in sorted(sizes)), initial=0), strict=False))
    row = F.col("__id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    starts = spark.createDataFrame(list(before.items()), "__part long, __start long")
    placed = kept.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return placed.withColumn(name, row + F.col("__start")).drop("__id", "__part", "__start")


def chunk_of(pos: Column, chunk_n: int = CHUNK_N) -> Column:
    return F.floor(pos / chunk_n).cast("long")


def page_of(at: Column, n: Column, page_n: int = PAGE_N) -> Column:
    """Page of position ``at`` in a chunk of n numbers, in pages of about equal
    size up to page_n: page i ends before floor((i + 1) n / pages)."""
    pages = F.ceil(n / page_n)
    return F.floor(((at + 1) * pages - 1) / n).cast("long")


def batch_of(at: Column) -> Column:
    return F.floor(at / BATCH_N).cast("long")


def with_pages(df: DataFrame, chunk_n: int = CHUNK_N, page_n: int = PAGE_N) -> DataFrame:
    """df (pos) with chunk_id, chunk_pos, page_id, page_pos and batch_id. The
    chunks' sizes come from their largest position, by one aggregate per chunk."""
    from pyspark.sql import Window

    df = df.withColumn("chunk_id", chunk_of(F.col("pos"), chunk_n)).withColumn("chunk_pos", F.col("pos") - F.col("chunk_id") * chunk_n)
    n = F.max("chunk_pos").over(Window.partitionBy("chunk_id")) + 1
    df = df.withColumn("chunk_len", n)
    pages = F.ceil(F.col("chunk_len") / page_n).cast("long")
    page = page_of(F.col("chunk_pos"), F.col("chunk_len"), page_n)
    df = df.withColumn("page_id", page)
    df = df.withColumn("page_pos", F.col("chunk_pos") - F.floor(F.col("page_id") * F.col("chunk_len") / pages).cast("long"))
    return df.withColumn("batch_id", batch_of(F.col("page_pos")))


def delta_sample(df: DataFrame, n: int, group: int = 200, extra: int | None = None) -> DataFrame:
    """The rows of a sequence of n on which a delta encoding is chosen."""
    extra = 1 + n // 10_000 if extra is None else extra
    gap = max(0, n - (extra + 1) * group) // extra if extra else 0
    pos = F.col("pos")
    return df.where((pos % (group + gap) < group) & (pos < (extra + 1) * (group + gap)))
