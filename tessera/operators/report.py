"""Reports over chunks and benchmark runs."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def name_contains(df: DataFrame, col: str, parts: list[str]) -> DataFrame:
    """Rows whose name contains any of the parts."""
    found = F.lit(False)
    for p in parts:
        found = found | F.col(col).contains(p)
    return df.where(found)


def column_of(df: DataFrame, name: str | None = None, index: int | None = None) -> str:
    """The column meant by a name or an index, or the only one."""
    if name is not None and index is not None:
        raise ValueError("give a name or an index, not both")
    if name is not None:
        if name not in df.columns:
            raise ValueError(f"no column {name!r} among {df.columns}")
        return name
    if index is not None:
        return df.columns[index]
    if len(df.columns) != 1:
        raise ValueError(f"which of {df.columns}?")
    return df.columns[0]


def median_runs(runs: DataFrame) -> DataFrame:
    """Median durations and the size for each (input, codec)."""
    return runs.groupBy("input", "codec").agg(F.median("compress_dt").alias("compress_dt"), F.median("decompress_dt").alias("decompress_dt"), F.max("compressed_size").alias("compressed_size"))


def rollup_runs(medians: DataFrame) -> DataFrame:
    """Sums by codec over inputs, with ``<sum>`` for all codecs."""
    out = medians.rollup("codec").agg(F.sum("compress_dt").alias("compress_dt"), F.sum("decompress_dt").alias("decompress_dt"), F.sum("compressed_size").alias("compressed_size"))
    return out.withColumn("codec", F.coalesce("codec", F.lit("<sum>")))


def upsert_results(old: DataFrame, new: DataFrame) -> DataFrame:
    """New results over old ones by (input, codec); a null duration keeps the old."""
    keys, values = ["input", "codec"], ["compress_dt", "decompress_dt", "compressed_size"]
    o = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values])
    both = o.join(new.select(*keys, *values), keys, "full_outer")
    return both.select(*keys, *[F.coalesce(v, f"old_{v}").alias(v) for v in values])


def inspect_totals(pages: DataFrame, width: int) -> DataFrame:
    """One row: numbers, plain and compressed bytes and their ratio, of a page
    table (n, meta_bytes, page_bytes)."""
    out = pages.agg(F.sum("n").alias("n"), F.sum(F.col("n") * width).alias("uncompressed_size"), F.sum(F.col("meta_bytes") + F.col("page_bytes")).alias("compressed_size"))
    return out.withColumn("ratio", F.round(F.col("uncompressed_size") / F.col("compressed_size"), 6))


def latent_var_summary(bins: DataFrame) -> DataFrame:
    """Per chunk and latent variable: bins, table size and bits, from bin rows."""
    share = F.col("weight") / F.pow(F.lit(2.0), F.col("size_log"))
    bits = F.sum(share * (F.col("size_log") - F.log2("weight") + F.col("offset_bits")))
    return bins.groupBy("chunk_id", "latent_var").agg(F.count(F.lit(1)).alias("n_bins"), F.max("size_log").alias("ans_size_log"), F.round(bits, 6).alias("approx_avg_bits"))


def prune_pages(pages: DataFrame, lo: int, hi: int) -> DataFrame:
    """Pages that can hold an ord in [lo, hi)."""
    return pages.where((F.col("max_ord") >= lo) & (F.col("min_ord") < hi))
