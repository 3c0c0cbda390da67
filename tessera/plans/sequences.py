"""The ordered sequences that the queries run on, in Spark and in SQL."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import timestamp_micros
from ..operators.layout import with_pages, with_position
from ..runtime import table

CHUNK, PAGE = 4096, 1000
ALL = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return with_position(df.withColumn("ts", timestamp_micros(F.col("ts"))), "event_id")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_position(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice"), "o_orderkey")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem", *ALL, "l_quantity", "l_discount", "l_tax")
    return with_position(df.withColumn("l_shipdate", timestamp_micros(F.col("l_shipdate"))), *ALL)


def paged(df: DataFrame) -> DataFrame:
    return with_pages(df, CHUNK, PAGE)


# The same in SQL, as common table expressions.
SEQ = {
    "events": "ev AS (SELECT event_id, epoch_us(ts) AS ts, user_id, event_type, value, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events)",
    "orders": "od AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders)",
    "lineitem": "li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, epoch_us(l_shipdate) AS l_shipdate, l_quantity, l_discount, l_tax, "
    f"row_number() OVER (ORDER BY {', '.join(ALL)}) - 1 AS pos FROM lineitem)",
}


def pages_sql(seq: str, name: str = "pg") -> str:
    """A further expression with chunks, pages and batches of a sequence."""
    return f"""{name}_c AS (SELECT *, pos // {CHUNK} AS chunk_id, pos % {CHUNK} AS chunk_pos, least({CHUNK}, count(*) OVER () - pos // {CHUNK} * {CHUNK}) AS chunk_len FROM {seq}),
{name}_p AS (SELECT *, (chunk_len + {PAGE - 1}) // {PAGE} AS n_pages, ((chunk_pos + 1) * ((chunk_len + {PAGE - 1}) // {PAGE}) - 1) // chunk_len AS page_id FROM {name}_c),
{name}_b AS (SELECT *, chunk_pos - page_id * chunk_len // n_pages AS page_pos FROM {name}_p),
{name} AS (SELECT *, page_pos // 256 AS batch_id FROM {name}_b)"""
