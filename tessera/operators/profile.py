"""What a column would cost: histograms, bins, divisors and bids."""
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.bits import bit_length, wrapping_sub
from ..functions.numbers import triple_gcd
from ..kernel.bins import histogram


def ntile_histogram(df: DataFrame, value: str, tie: str, n_log: int, group: str = "chunk_id") -> DataFrame:
    """(group, bin, lower, upper, n): equal-count bins by rank inside a group."""
    w = Window.partitionBy(group).orderBy(value, tie)
    binned = df.select(group, value, F.ntile(1 << n_log).over(w).alias("bin"))
    return binned.groupBy(group, "bin").agg(F.min(value).alias("lower"), F.max(value).alias("upper"), F.count(F.lit(1)).alias("n"))


def exact_histogram(df: DataFrame, value: str, n_log: int, group: str = "chunk_id") -> DataFrame:
    """(group, bin, lower, upper, n): the codec's own bins, in which equal values
    are never split. One task holds one group, so groups are chunks."""
    kind = df.schema[group].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        n, lower, upper = histogram(np.sort(table.column(value).to_numpy()), n_log)
        keys = pa.array([table.column(group)[0].as_py()] * len(n), table.schema.field(group).type)
        return pa.table([keys, pa.array(np.arange(len(n), dtype=np.int32)), pa.array(lower), pa.array(upper), pa.array(n)], names=[group, "bin", "lower", "upper", "n"])

    some = df.select(group, F.col(value).cast("long").alias(value)).where(F.col(value).isNotNull())
    return some.groupBy(group).applyInArrow(run, f"{group} {kind}, bin int, lower long, upper long, n long")


def bin_index(rank: Column, n: Column, n_log: int) -> Column:
    """Bin of the value at 0-based rank among n."""
    return F.floor(F.shiftleft(rank, n_log) / n).cast("long")


def assign_bins(df: DataFrame, bins: DataFrame, value: str, key: str = "chunk_id") -> DataFrame:
    """Each value with the bin of the same group whose lower bound is the last
    not above it (the first bin if there is none). Values and bounds are sorted
    together by group, so it is one pass and not a range join; bins (key, bin,
    lower) may be as many as they like."""
    marks = bins.select(key, F.col("lower").alias("__at"), F.struct("lower", "bin").alias("__bin"))
    both = df.withColumn("__at", F.col(value)).withColumn("__row", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col("__at"), F.col("__row").isNotNull())
    before = F.last("__bin", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lowest = F.min("__bin").over(Window.partitionBy(key))
    chosen = both.withColumn("__bin", F.coalesce(before, lowest)).where(F.col("__row"))
    out = chosen.withColumn("bin", F.col("__bin.bin")).withColumn("lower", F.col("__bin.lower"))
    return out.withColumn("offset", wrapping_sub(F.col(value), F.col("lower"))).drop("__at", "__row", "__bin")


def min_max(df: DataFrame, value: str, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("min_ord"), F.max(value).alias("max_ord"), F.count(F.lit(1)).alias("n"))


def bin_cost(n: Column, lower: Column, upper: Column, total: Column, meta_bits: float) -> Column:
    """Estimated bits of a bin with its metadata."""
    return F.lit(float(meta_bits)) + (F.log2(total) - F.log2(n) + bit_length(wrapping_sub(upper, lower))) * n


def average_bits(weight: Column, size_log: Column, offset_bits: Column) -> Column:
    """Sum expression: mean bits per latent of weighted bins."""
    return F.sum(weight / F.pow(F.lit(2.0), size_log) * (size_log - F.log2(weight) + offset_bits))


def worst_bits(n: Column, weight: Column, size_log: Column, offset_bits: Column) -> Column:
    """Sum expression: bits that a body never exceeds."""
    return F.sum(n * (offset_bits + size_log - (bit_length(weight) - 1)))


def consecutive_triples(df: DataFrame, value: str) -> DataFrame:
    """Triple gcd of positions 3i, 3i+1, 3i+2; an incomplete one is left out."""
    t = df.groupBy(F.floor(F.col("pos") / 3).cast("long").alias("triple")).agg(*[F.max(F.when(F.col("pos") % 3 == i, F.col(value))).alias(f"x{i}") for i in range(3)])
    t = t.where("x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL")
    return t.withColumn("gcd", triple_gcd(F.col("x0"), F.col("x1"), F.col("x2")))


def savings(df: DataFrame, primary: str, saved: str, memorizable: int = 256) -> DataFrame:
    """One row: mean bits saved over primaries that are infrequent. Partial
    sums per primary, then over primaries; the total is broadcast."""
    groups = df.groupBy(primary).agg(F.count(F.lit(1)).alias("n"), F.sum(saved).alias("saved"))
    total = groups.agg(F.sum("n").alias("total"))
    rare = F.col("n") <= F.greatest(F.lit(1), F.floor(F.col("total") / memorizable))
    return groups.crossJoin(F.broadcast(total)).agg((F.sum(F.when(rare, F.col("saved")).otherwise(0.0)) / F.max("total")).alias("bits_saved"))


def winning_bid(bids: DataFrame, *keys: str) -> DataFrame:
    """The bid with the most savings for each key; of equal ones the later."""
    best = F.max_by(F.struct("mode", "bits_saved", "bid_no"), F.struct("bits_saved", "bid_no")).alias("best")
    return bids.groupBy(*keys).agg(best).select(*keys, "best.mode", "best.bits_saved")


def range_gcd(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Greatest common divisor of the distances to the smallest value, per key.
    Each task folds its rows to one divisor per key; the rest is as many numbers
    as tasks."""
    low = df.groupBy(*keys).agg(F.min(value).alias("__low"))
    far = df.join(low, list(keys)).select(*keys, (F.col(value) - F.col("__low")).alias("gcd"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}
        for batch in batches:
            groups = pa.table(batch).group_by(list(keys)).aggregate([("gcd", "list")])
            for r in groups.to_pylist():
                k = tuple(r[c] for c in keys)
                held[k] = math.gcd(held.get(k, 0), int(np.gcd.reduce(np.array([d for d in r["gcd_list"] if d is not None] or [0]))))
        rows = [dict(zip(keys, k, strict=True)) | {"gcd": g} for k, g in held.items()]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = to_arrow_schema(far.schema)
    parts = far.mapInArrow(run, far.schema)
    fold = lambda a, b: F.aggregate(F.sequence(F.lit(1), F.lit(96)), F.struct(a.alias("x"), b.alias("y")), lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, F.lit(1)).otherwise(s["y"])).alias("y"))), lambda s: s["x"])
    return parts.groupBy(*keys).agg(F.collect_list("gcd").alias("gs")).select(*keys, F.aggregate("gs", F.lit(0).cast("long"), fold).alias("gcd"))


def hash_sample(df: DataFrame, pos: str = "pos", one_in: int = 40) -> DataFrame:
    """A deterministic sample of about one in ``one_in`` rows."""
    return df.where(F.pmod(F.col(pos) * 2654435761, F.lit(1 << 32)) < (1 << 32) // one_in)
