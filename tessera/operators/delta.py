"""Delta encodings as window expressions, per page."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bits import wrap, wrapping_add, wrapping_sub

PAGE = ("chunk_id", "page_id")


def _by(page: tuple[str, ...], pos: str) -> Window:
    return Window.partitionBy(*page).orderBy(pos)


def deltas(df: DataFrame, col: str, order: int, page: tuple[str, ...] = PAGE, pos: str = "pos", out: str = "delta") -> DataFrame:
    """Wrapping differences of the given order; the first ``order`` rows of a
    page have none and are left out. One sort serves all orders."""
    w = _by(page, pos)
    df = df.withColumn(out, F.col(col))
    for _ in range(order):
        df = df.withColumn(out, wrapping_sub(F.col(out), F.lag(out).over(w)))
    return df.where(F.col(out).isNotNull())


def moments(df: DataFrame, col: str, order: int, page: tuple[str, ...] = PAGE, pos: str = "pos") -> DataFrame:
    """(page, moments): a page's first value and first difference of each lower
    order, 0 where the page is too short."""
    w = _by(page, pos)
    df = df.withColumn("__d0", F.col(col))
    for i in range(1, order):
        df = df.withColumn(f"__d{i}", wrapping_sub(F.col(f"__d{i - 1}"), F.lag(f"__d{i - 1}").over(w)))
    firsts = [F.coalesce(F.min_by(f"__d{i}", F.when(F.col(f"__d{i}").isNotNull(), F.col(pos))), F.lit(0)).alias(f"moment{i}") for i in range(order)]
    return df.groupBy(*page).agg(*firsts)


def undelta(df: DataFrame, delta: str, moment: str, page: tuple[str, ...] = PAGE, pos: str = "pos", out: str = "ord") -> DataFrame:
    """Values from order-1 differences (null on a page's first row) and the
    page's first value: a running sum that wraps."""
    w = _by(page, pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(F.coalesce(F.col(delta), F.lit(0)).cast("decimal(28,0)")).over(w)
    return df.withColumn(out, wrapping_add(F.col(moment), wrap(total)))


def best_fixed_lookback(df: DataFrame, col: str, most: int = 6, page: tuple[str, ...] = PAGE, pos: str = "pos") -> DataFrame:
    """For each row but a page's first: the lag up to ``most`` with the smallest
    difference, the nearest of equal ones."""
    w = _by(page, pos)
    lags = [F.lag(col, i).over(w) for i in range(1, most + 1)]
    df = df.withColumn("__lags", F.array(*lags))
    pairs = F.transform("__lags", lambda v, i: F.struct(F.abs(F.col(col) - v).alias("size"), (i + 1).cast("int").alias("lag")))
    df = df.withColumn("__best", F.array_min(F.filter(pairs, lambda p: p["size"].isNotNull())))
    return df.where(F.col("__best").isNotNull()).withColumn("lookback", F.col("__best.lag")).withColumn("size", F.col("__best.size")).drop("__lags", "__best")


def runs(df: DataFrame, col: str, page: tuple[str, ...], pos: str = "pos") -> DataFrame:
    """(page, value, first position, length) of runs of equal values."""
    w = _by(page, pos)
    start = F.when(F.lag(col).over(w).eqNullSafe(F.col(col)) & (F.row_number().over(w) > 1), F.lit(0)).otherwise(F.lit(1))
    run = F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn("__start", start).withColumn("__run", run).groupBy(*page, "__run", col).agg(F.min(pos).alias("start_pos"), F.count(F.lit(1)).alias("run_length")).drop("__run")


def xor_delta(df: DataFrame, col: str, page: tuple[str, ...], pos: str = "pos", out: str = "delta") -> DataFrame:
    """Booleans that say whether a value differs from the one before."""
    w = _by(page, pos)
    return df.withColumn(out, F.col(col) != F.lag(col).over(w)).where(F.col(out).isNotNull())


def streaming_sum(df: DataFrame, col: str) -> DataFrame:
    """Sum and count, for a batch or a stream."""
    return df.agg(F.sum(col).alias("total"), F.count(col).alias("n"))


def reverse_cumulative(counts: DataFrame, key: str, n: str, out: str = "at_least") -> DataFrame:
    """Counts of keys at least as large; one row per key, so few rows."""
    return counts.withColumn(out, F.sum(n).over(Window.orderBy(F.desc(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
