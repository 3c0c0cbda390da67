"""Queries that go through the codec's bytes; what is decoded must equal the source."""
from pyspark.sql import functions as F

from ..functions.numbers import timestamp_micros
from ..operators import report
from ..runtime import Scratch, table
from ..sources import columns, datasource, files
from ..sources.bench import CODECS, run_codecs

QUERIES, SQL = {}, {}
CHUNK = 1 << 14


def _round_trip(name: str, source: str, col: str, keys: tuple[str, ...], value_sql: str, ntype: str | None = None, prepare=None, **how):
    def run(spark, d):
        df = table(spark, d, source)
        df = prepare(df) if prepare else df
        pages = Scratch(spark, "pages").keep(columns.compress(df, col, *keys, options=columns.config(**how), ntype=ntype, chunk_n=CHUNK), name)
        kind = ntype or columns.ntype_of(df, col)
        x = F.col("x").cast("long") if kind == "u64" else F.col("x").cast("double") if kind in ("f16", "f32") else F.col("x")
        return columns.decompress(pages, kind).select("pos", x.alias("x"))

    QUERIES[f"roundtrip_{name}"] = run
    SQL[f"roundtrip_{name}"] = f"SELECT row_number() OVER (ORDER BY {', '.join(keys)}) - 1 AS pos, {value_sql} AS x FROM {source}"


ALL = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")
OD = ("orders", "o_custkey", ("o_orderkey",), "o_custkey")
PRICE = ("orders", "o_totalprice", ("o_orderkey",), "o_totalprice")
_round_trip("i64", *OD)
_round_trip("i32", "part", "p_size", ("p_partkey",), "p_size")
_round_trip("i16", "customer", "c_nationkey", ("c_custkey",), "CAST(c_nationkey AS SMALLINT)", ntype="i16")
_round_trip("u16", "part", "p_size", ("p_partkey",), "p_size", ntype="u16")
_round_trip("u32", *OD, ntype="u32")
_round_trip("u64", *OD, ntype="u64")
_round_trip("f64", *PRICE)
_round_trip("f16", "part", "p_size", ("p_partkey",), "CAST(p_size AS DOUBLE)", ntype="f16")
_round_trip("timestamp", "events", "ts", ("event_id",), "epoch_us(ts)")
_round_trip("date", "orders", "d", ("o_orderkey",), "CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS INTEGER)", prepare=lambda df: df.withColumn("d", F.to_date("o_orderdate")))
_round_trip("int_mult", "lineitem", "l_shipdate", ALL, "epoch_us(l_shipdate)", mode="intmult@86400000000")
_round_trip("float_mult", *PRICE, mode="floatmult@0.01")
_round_trip("float_quant", "events", "value", ("event_id",), "value", mode="floatquant@20")
_round_trip("consecutive", "events", "ts", ("event_id",), "epoch_us(ts)", delta="consecutive@2")
_round_trip("lookback", "events", "user_id", ("event_id",), "user_id", delta="lookback")
_round_trip("multipage", *PRICE, page_n=100)
_round_trip("classic_none", *PRICE, mode="classic", delta="none", level=12)
_round_trip("level0", *PRICE, level=0)


def roundtrip_f32(spark, d):
    """The elements of the embeddings as one sequence of f32."""
    df = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("idx", "v"))
    pages = Scratch(spark, "pages").keep(columns.compress(df, "v", "vec_id", "idx", options=columns.config(), chunk_n=CHUNK), "f32")
    return columns.decompress(pages, "f32").select("pos", F.col("x").cast("double").alias("x"))


QUERIES["roundtrip_f32"] = roundtrip_f32
SQL["roundtrip_f32"] = """WITH e AS (SELECT vec_id, unnest(range(len(embedding))) AS idx, unnest(embedding) AS v FROM embeddings)
SELECT row_number() OVER (ORDER BY vec_id, idx) - 1 AS pos, CAST(v AS DOUBLE) AS x FROM e"""


def _event_pages(spark, d):
    df = table(spark, d, "events", "event_id", "ts")
    return Scratch(spark, "pages").keep(columns.compress(df, "ts", "event_id", options=columns.config(page_n=500), chunk_n=4096), "ts")


def compressed_range_scan(spark, d):
    """Timestamps of a range out of compressed pages, by the pages' bounds."""
    pages = _event_pages(spark, d)
    lo, hi = pages.agg(F.min("min_ord"), F.max("max_ord")).first()
    return columns.decompress(pages, "i64", lo + (hi - lo) // 3, lo + (hi - lo) // 2)


QUERIES["compressed_range_scan"] = compressed_range_scan
SQL["compressed_range_scan"] = """WITH e AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, epoch_us(ts) AS x FROM events), b AS (SELECT min(x) AS lo, max(x) AS hi FROM e)
SELECT pos, x FROM e, b WHERE x >= lo + (hi - lo) // 3 AND x < lo + (hi - lo) // 2"""


def metadata_count(spark, d):
    """Numbers and bounds of each chunk without touching a payload."""
    pages = _event_pages(spark, d)
    return pages.groupBy("chunk_id").agg(F.sum("n").alias("n"), F.min("min_ord").alias("min_ord"), F.max("max_ord").alias("max_ord"))


QUERIES["metadata_count"] = metadata_count
SQL["metadata_count"] = """WITH e AS (SELECT (row_number() OVER (ORDER BY event_id) - 1) // 4096 AS chunk_id, epoch_us(ts) AS x FROM events)
SELECT chunk_id, count(*) AS n, min(x) AS min_ord, max(x) AS max_ord FROM e GROUP BY 1"""


def codec_file_scan(spark, d):
    """A column through standalone files, one for each range of keys: written by the
    data source, scanned as files, numbered in their order."""
    datasource.register(spark)
    path = Scratch(spark, "files").path("custkey")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = table(spark, d, "orders", "o_orderkey", "o_custkey").repartitionByRange(n, "o_orderkey").sortWithinPartitions("o_orderkey")
    df.select(F.col("o_custkey").alias("x")).write.format("tessera").option("chunkN", 5000).mode("append").save(path)
    return files.in_order(files.scan(spark, f"{path}/*.tcol", "standalone", "i64")).select("pos", "x")


QUERIES["codec_file_scan"] = codec_file_scan
SQL["codec_file_scan"] = "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_custkey AS x FROM orders"


def codec_choices(spark, d):
    """Mode, delta and sizes that each chunk of the price column chose."""
    df = table(spark, d, "orders", "o_orderkey", "o_totalprice")
    return columns.chunk_info(Scratch(spark, "pages").keep(columns.compress(df, "o_totalprice", "o_orderkey", chunk_n=CHUNK), "price"))


def codec_bins(spark, d):
    """Bins of every latent variable, summarised from metadata."""
    pages = _event_pages(spark, d)
    return report.latent_var_summary(columns.bin_rows(pages))


def codec_bench(spark, d):
    """Sizes and median durations of all codecs on two columns."""
    df = table(spark, d, "events", "event_id", "ts", "value").withColumn("ts", timestamp_micros(F.col("ts")))
    runs = run_codecs(df, {"ts": "i64", "value": "f64"}, "event_id", list(CODECS), chunk_n=CHUNK, iters=1)
    return report.rollup_runs(report.median_runs(runs))


QUERIES |= {"codec_choices": codec_choices, "codec_bins": codec_bins, "codec_bench": codec_bench}
