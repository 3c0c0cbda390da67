"""Registered queries of the column engine: name, query, SQL that DuckDB checks it with."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bits, numbers, sizes
from ..operators import delta, layout, profile, report
from ..runtime import table
from . import codec_queries
from .sequences import CHUNK, SEQ, events, lineitem, orders, paged, pages_sql

_QUERIES, _SQL = {}, {}
EV, OD, LI = (f"WITH {SEQ[k]}" for k in ("events", "orders", "lineitem"))
EVP, ODP = f"{EV}, {pages_sql('ev')}", f"{OD}, {pages_sql('od')}"
DAY = 86_400_000_000
#: Float bits to ords and back, in SQL.
F64 = "(CASE WHEN ({0}::BIT)::BIGINT >= 0 THEN ({0}::BIT)::BIGINT ELSE xor(({0}::BIT)::BIGINT, 9223372036854775807) END)"
TO_U64 = "({0}::HUGEINT + 9223372036854775808)"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql
        return f

    return add


def queries():
    return _QUERIES | codec_queries.QUERIES


def oracle_sql():
    return _SQL | codec_queries.SQL


# -- scans and predicates ----------------------------------------------------


@query("SELECT l_orderkey, l_extendedprice FROM lineitem")
def scan_project_column(spark, d):
    return table(spark, d, "lineitem", "l_orderkey", "l_extendedprice")


@query(f"{EV} SELECT pos % 2 AS channel, pos // 2 AS frame, event_id FROM ev")
def stride_deinterleave(spark, d):
    pos = F.col("pos")
    return events(spark, d).select((pos % 2).alias("channel"), F.floor(pos / 2).alias("frame"), "event_id")


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring') OR contains(p_name, 'small')")
def filter_name_contains(spark, d):
    return report.name_contains(table(spark, d, "part", "p_partkey", "p_name"), "p_name", ["ring", "small"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 1000")
def decode_limit(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").orderBy("o_orderkey").limit(1000)


@query(f"{OD} SELECT o_orderkey, pos FROM od WHERE pos < 5000")
def truncate_dataset(spark, d):
    return orders(spark, d).where("pos < 5000").select("o_orderkey", "pos")


@query("SELECT c_custkey, abs(c_acctbal) AS sampled FROM customer WHERE NOT isnan(c_acctbal) AND abs(c_acctbal) >= 2.2250738585072014e-308 AND abs(c_acctbal) <= 8.988465674311579e307")
def float_sample_filter(spark, d):
    df = table(spark, d, "customer", "c_custkey", "c_acctbal")
    return df.where(numbers.float_sample(F.col("c_acctbal"))).select("c_custkey", F.abs("c_acctbal").alias("sampled"))


@query(f"{EVP} SELECT event_id, ts, value FROM pg WHERE ts >= (SELECT min(ts) + (max(ts) - min(ts)) // 3 FROM ev) AND ts < (SELECT min(ts) + (max(ts) - min(ts)) // 2 FROM ev)")
def page_pruned_range_scan(spark, d):
    """Rows of a range of timestamps: the sequence is stored in its order, so the
    bounds prune the stored row groups by their statistics, and only columns that
    are asked for are read."""
    df = events(spark, d)
    lo, hi = df.agg(F.min("ts"), F.max("ts")).first()
    lo, hi = (lo + (hi - lo) // 3, lo + (hi - lo) // 2) if lo is not None else (0, 0)
    return df.where((F.col("ts") >= lo) & (F.col("ts") < hi)).select("event_id", "ts", "value")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 100000 AND 150000")
def bin_membership(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").where(F.col("o_totalprice").between(100000, 150000)).select("o_orderkey")


# -- layout --------------------------------------------------------------------


@query(f"{ODP} SELECT o_orderkey, chunk_id, page_id, page_pos FROM pg")
def page_assignment(spark, d):
    return paged(orders(spark, d)).select("o_orderkey", "chunk_id", "page_id", "page_pos")


@query(f"{ODP} SELECT chunk_id, page_id, count(*) AS n FROM pg GROUP BY ALL")
def page_sizes(spark, d):
    return paged(orders(spark, d)).groupBy("chunk_id", "page_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{ODP} SELECT o_orderkey, batch_id FROM pg")
def batch_assignment(spark, d):
    return paged(orders(spark, d)).select("o_orderkey", "batch_id")


@query(f"{OD} SELECT o_orderkey, pos // {CHUNK} AS chunk_id FROM od")
def chunk_assignment(spark, d):
    return orders(spark, d).select("o_orderkey", layout.chunk_of(F.col("pos"), CHUNK).alias("chunk_id"))


@query(f"{EV} SELECT event_id, pos FROM ev, (SELECT count(*) AS n FROM ev) WHERE pos % (200 + greatest(0, n - (2 + n // 10000) * 200) // (1 + n // 10000)) < 200 AND pos < (2 + n // 10000) * (200 + greatest(0, n - (2 + n // 10000) * 200) // (1 + n // 10000))")
def delta_sample_positions(spark, d):
    df = events(spark, d)
    return layout.delta_sample(df, df.count()).select("event_id", "pos")


@query(f"{OD} SELECT o_orderkey, pos FROM od WHERE (pos * 2654435761) % 4294967296 < 4294967296 // 40")
def hash_sample(spark, d):
    return profile.hash_sample(orders(spark, d)).select("o_orderkey", "pos")


@query(f"{OD} SELECT 0 AS chunk_id, pos, o_orderkey AS x FROM od UNION ALL SELECT 1, pos, o_custkey FROM od")
def multi_chunk_concat(spark, d):
    df = orders(spark, d)
    a, b = (df.select(F.lit(i).alias("chunk_id"), "pos", F.col(c).alias("x")) for i, c in enumerate(("o_orderkey", "o_custkey")))
    return a.unionByName(b).orderBy("chunk_id", "pos")


# -- scalar functions --------------------------------------------------------------


@query("SELECT o_orderkey, o_orderkey AS ord, CAST(o_orderkey::HUGEINT + 9223372036854775808 AS VARCHAR) AS latent FROM orders")
def int_to_ord(spark, d):
    o = numbers.int_to_ord(F.col("o_orderkey"))
    return table(spark, d, "orders", "o_orderkey").select("o_orderkey", o.alias("ord"), numbers.to_latent(o).cast("string").alias("latent"))


@query(f"SELECT c_custkey, {F64.format('c_acctbal')} AS ord FROM customer")
def f64_to_ord(spark, d):
    return table(spark, d, "customer", "c_custkey", "c_acctbal").select("c_custkey", numbers.f64_to_ord(F.col("c_acctbal")).alias("ord"))


@query("SELECT c_custkey, c_acctbal AS x FROM customer")
def ord_to_f64(spark, d):
    x = numbers.ord_to_f64(numbers.f64_to_ord(F.col("c_acctbal")))
    return table(spark, d, "customer", "c_custkey", "c_acctbal").select("c_custkey", x.alias("x"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS idx FROM embeddings)
SELECT vec_id, idx, CAST(CASE WHEN (x::BIT)::INTEGER >= 0 THEN (x::BIT)::INTEGER ELSE xor((x::BIT)::INTEGER, 2147483647) END AS BIGINT) AS ord FROM e""")
def f32_to_ord(spark, d):
    df = table(spark, d, "embeddings", "vec_id", "embedding").select("vec_id", F.posexplode("embedding").alias("idx", "x"))
    return df.select("vec_id", F.col("idx").cast("long").alias("idx"), numbers.f32_to_ord(F.col("x")).alias("ord"))


@query(f"""WITH o AS (SELECT c_custkey, {F64.format('c_acctbal')} AS o FROM customer), s AS (SELECT c_custkey, (o::HUGEINT - 9223372036854775807) AS d FROM o)
SELECT c_custkey, CAST(CASE WHEN d < -9223372036854775808 THEN d + 18446744073709551616 WHEN d > 9223372036854775807 THEN d - 18446744073709551616 ELSE d END AS BIGINT) AS diff FROM s""")
def wrapping_sub(spark, d):
    o = numbers.f64_to_ord(F.col("c_acctbal"))
    df = table(spark, d, "customer", "c_custkey", "c_acctbal").select("c_custkey", o.alias("o"))
    return df.select("c_custkey", bits.wrapping_sub(F.col("o"), F.lit((1 << 63) - 1)).alias("diff"))


@query("SELECT event_id, xor(event_id, -9223372036854775808) AS latent_bits FROM events")
def toggle_center(spark, d):
    return table(spark, d, "events", "event_id").select("event_id", bits.toggle_center(F.col("event_id")).alias("latent_bits"))


@query(f"{EV} SELECT event_id, CAST({TO_U64.format('ts')} // {DAY} AS BIGINT) AS mult, CAST({TO_U64.format('ts')} % {DAY} AS BIGINT) AS adj FROM ev")
def int_mult_split(spark, d):
    mult, adj = numbers.int_mult_split(F.col("ts"), DAY)
    df = table(spark, d, "events", "event_id", "ts").withColumn("ts", numbers.timestamp_micros(F.col("ts")))
    return df.select("event_id", mult.cast("long").alias("mult"), adj.cast("long").alias("adj"))


@query(f"{EV} SELECT event_id, ts FROM ev")
def int_mult_join(spark, d):
    mult, adj = numbers.int_mult_split(F.col("ts"), DAY)
    df = table(spark, d, "events", "event_id", "ts").withColumn("ts", numbers.timestamp_micros(F.col("ts")))
    df = df.select("event_id", mult.alias("mult"), adj.alias("adj"))
    return df.select("event_id", numbers.int_mult_join(F.col("mult"), F.col("adj"), DAY).alias("ts"))


FLOAT_MULT = f"WITH m AS (SELECT o_orderkey, o_totalprice AS x, round(o_totalprice * (1.0::DOUBLE / 0.01::DOUBLE)) AS mult FROM orders) SELECT o_orderkey, mult, {F64.format('x')} - {F64.format('(mult * 0.01::DOUBLE)')} AS adj FROM m"


@query(FLOAT_MULT)
def float_mult_split(spark, d):
    mult, adj = numbers.float_mult_split(F.col("o_totalprice"), 0.01)
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", mult.alias("mult"), adj.alias("adj"))


@query("SELECT o_orderkey, o_totalprice FROM orders")
def float_mult_join(spark, d):
    mult, adj = numbers.float_mult_split(F.col("o_totalprice"), 0.01)
    df = table(spark, d, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", mult.alias("mult"), adj.alias("adj"))
    return df.select("o_orderkey", numbers.float_mult_join(F.col("mult"), F.col("adj"), 0.01).alias("o_totalprice"))


@query(f"WITH o AS (SELECT event_id, {F64.format('value')} AS o FROM events) SELECT event_id, o >> 20 AS quantum, CASE WHEN o >= 0 THEN o & 1048575 ELSE 1048575 - (o & 1048575) END AS rest FROM o")
def float_quant_split(spark, d):
    df = table(spark, d, "events", "event_id", "value").select("event_id", numbers.f64_to_ord(F.col("value")).alias("o"))
    quantum, rest = numbers.float_quant_split(F.col("o"), 20)
    return df.select("event_id", quantum.alias("quantum"), rest.alias("rest"))


@query(f"SELECT c_custkey, {F64.format('c_acctbal')} AS ord FROM customer")
def float_quant_join(spark, d):
    df = table(spark, d, "customer", "c_custkey", "c_acctbal").select("c_custkey", numbers.f64_to_ord(F.col("c_acctbal")).alias("o"))
    quantum, rest = numbers.float_quant_split(F.col("o"), 20)
    df = df.select("c_custkey", quantum.alias("q"), rest.alias("r"))
    return df.select("c_custkey", numbers.float_quant_join(F.col("q"), F.col("r"), 20).alias("ord"))


#: Integers up to 2**53 one by one, then every float; a negative one, -0.0 too, is one less.
RANK = "CASE WHEN ({0}::BIT)::BIGINT >= 0 THEN {1} ELSE -1 - {1} END"
SIZE = "(CASE WHEN abs({0}) < 9007199254740992 THEN CAST(abs({0}) AS BIGINT) ELSE (abs({0})::BIT)::BIGINT - (9007199254740992.0::DOUBLE::BIT)::BIGINT + 9007199254740992 END)"


@query(f"WITH r AS (SELECT c_custkey, round(c_acctbal) + 0.0::DOUBLE AS x FROM customer), f AS (SELECT *, -x * 1152921504606846976.0::DOUBLE AS y FROM r) SELECT c_custkey, {RANK.format('x', SIZE.format('x'))} AS rank, {RANK.format('y', SIZE.format('y'))} AS far FROM f")
def int_float_rank(spark, d):
    """Ranks of whole balances, and of their negatives times 2**60."""
    df = table(spark, d, "customer", "c_custkey", "c_acctbal").select("c_custkey", (F.round("c_acctbal") + F.lit(0.0)).alias("x"))
    df = df.withColumn("y", -F.col("x") * F.lit(2.0**60))
    return df.select("c_custkey", numbers.int_float_rank(F.col("x")).alias("rank"), numbers.int_float_rank(F.col("y")).alias("far"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, gcd(l_partkey, l_suppkey) AS g FROM lineitem")
def pair_gcd(spark, d):
    df = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    return df.select("*", numbers.pair_gcd(F.col("l_partkey"), F.col("l_suppkey")).alias("g"))


TRIPLES = """t AS (SELECT pos // 3 AS triple, max(CASE WHEN pos % 3 = 0 THEN l_shipdate END) AS a, max(CASE WHEN pos % 3 = 1 THEN l_shipdate END) AS b, max(CASE WHEN pos % 3 = 2 THEN l_shipdate END) AS c FROM li GROUP BY 1 HAVING count(*) = 3),
g AS (SELECT triple, gcd(gcd(a - least(a, b, c), b - least(a, b, c)), c - least(a, b, c)) AS gcd FROM t)"""


@query(f"{LI}, {TRIPLES} SELECT triple, gcd FROM g")
def triple_gcd(spark, d):
    return profile.consecutive_triples(lineitem(spark, d), "l_shipdate").select("triple", "gcd")


@query(f"{LI}, {TRIPLES} SELECT gcd, count(*) AS n FROM g WHERE gcd > 1 GROUP BY gcd")
def triple_gcd_counts(spark, d):
    return profile.consecutive_triples(lineitem(spark, d), "l_shipdate").where("gcd > 1").groupBy("gcd").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_custkey = 0 THEN 0 ELSE length(bin(o_custkey)) END AS n_bits FROM orders")
def bit_length_of_range(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", bits.bit_length(F.col("o_custkey")).alias("n_bits"))


@query("SELECT o_orderkey, o_custkey & 63 AS low FROM orders")
def lowest_bits(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", bits.lowest_bits(F.col("o_custkey"), 6).alias("low"))


@query("WITH p AS (SELECT event_type, count(*) / sum(count(*)) OVER () AS p FROM events GROUP BY 1) SELECT event_type, round(CASE WHEN p IN (0, 1) THEN 0.0 ELSE -p * log2(p) END, 6) AS entropy FROM p")
def categorical_entropy(spark, d):
    df = table(spark, d, "events", "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return df.crossJoin(F.broadcast(total)).select("event_type", F.round(sizes.categorical_entropy(p), 6).alias("entropy"))


@query("SELECT o_orderkey, CAST((((o_totalprice::BIT)::BIGINT >> 52) & 2047) - 1023 AS INTEGER) AS exponent FROM orders")
def float_exponent(spark, d):
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", numbers.float_exponent(F.col("o_totalprice")).alias("exponent"))


TRAILING = "CASE WHEN {0} = 0 THEN 52 ELSE least(52, length(bin({0} & -{0})) - 1) END"


@query(f"WITH b AS (SELECT l_orderkey, l_partkey, (l_quantity::BIT)::BIGINT AS b FROM lineitem) SELECT l_orderkey, l_partkey, {TRAILING.format('b')} AS zeros FROM b")
def float_trailing_zeros(spark, d):
    return table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_quantity").select("l_orderkey", "l_partkey", numbers.float_trailing_zeros(F.col("l_quantity")).alias("zeros"))


@query("""WITH b AS (SELECT DISTINCT l_discount AS base, 1.0::DOUBLE / l_discount AS inv FROM lineitem WHERE l_discount > 0)
SELECT base, CASE WHEN abs(inv - round(inv)) < 0.02 THEN 1.0::DOUBLE / round(inv) WHEN abs(inv - pow(10.0::DOUBLE, round(log10(inv)))) / inv < 0.01 THEN 1.0::DOUBLE / pow(10.0::DOUBLE, round(log10(inv))) ELSE base END AS snapped FROM b""")
def snap_base(spark, d):
    df = table(spark, d, "lineitem", "l_discount").where("l_discount > 0").distinct()
    return df.select(F.col("l_discount").alias("base"), numbers.snap_base(F.col("l_discount")).alias("snapped"))


@query(f"{EVP}, x AS (SELECT event_id, ts - lag(ts) OVER (PARTITION BY chunk_id, page_id ORDER BY pos) AS d FROM pg) SELECT event_id, CASE WHEN d >= 0 THEN '+' ELSE '' END || d || ' us' AS text FROM x WHERE d IS NOT NULL")
def describe_latent(spark, d):
    df = delta.deltas(paged(events(spark, d)), "ts", 1)
    return df.select("event_id", numbers.describe_latent(F.col("delta"), "delta", " us").alias("text"))


@query(f"{EV} SELECT event_id, ts // 1000000 AS seconds, ts % 1000000 AS micros FROM ev")
def timestamp_parts(spark, d):
    df = table(spark, d, "events", "event_id", "ts").withColumn("ts", numbers.timestamp_micros(F.col("ts")))
    seconds, part = numbers.timestamp_parts(F.col("ts"))
    return df.select("event_id", seconds.alias("seconds"), part.alias("micros"))


# -- sizes ---------------------------------------------------------------------------


GROUPS = "WITH g AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)"
LEN = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END"


def _groups(spark, d) -> DataFrame:
    return table(spark, d, "events", "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"{GROUPS}, f AS (SELECT user_id, greatest(0, {LEN.format('n')} - 5) AS f FROM g) SELECT user_id, CASE WHEN 8 <= f THEN 8 ELSE f + (8 - f) // 2 END AS log FROM f")
def bins_log_for_n(spark, d):
    return _groups(spark, d).select("user_id", sizes.bins_log(8, F.col("n")).alias("log"))


@query(f"{GROUPS} SELECT user_id, CASE WHEN n >= 10 THEN 10 + (n - 10) // 40 END AS size FROM g")
def sample_size(spark, d):
    return _groups(spark, d).select("user_id", sizes.sample_size(F.col("n")).alias("size"))


@query(f"{GROUPS} SELECT user_id, least(greatest({LEN.format('(n - 1)')}, 4), 15) AS log FROM g")
def lookback_window_log(spark, d):
    return _groups(spark, d).select("user_id", sizes.lookback_window_log(F.col("n")).alias("log"))


@query(f"{GROUPS} SELECT user_id, 6 + greatest({LEN.format('n')}, 1) AS n_bits FROM g")
def varint_size(spark, d):
    return _groups(spark, d).select("user_id", sizes.varint_bits(F.col("n")).alias("n_bits"))


@query(f"{GROUPS} SELECT user_id, (98 + 7) // 8 + n * 8 AS wrapped, (98 + 7) // 8 + n * 8 + 4 AS standalone FROM g")
def size_guarantee(spark, d):
    n = F.col("n")
    return _groups(spark, d).select("user_id", sizes.wrapped_guarantee(n, 64).alias("wrapped"), sizes.standalone_guarantee(n, 64).alias("standalone"))


@query(f"{GROUPS} SELECT user_id, 27 + n * (10 + 64 + 7) AS n_bits FROM g")
def exact_meta_size(spark, d):
    return _groups(spark, d).select("user_id", sizes.chunk_meta_bits(F.lit(10), F.col("n"), 64).alias("n_bits"))


@query("WITH g AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), t AS (SELECT sum(n)::BIGINT AS total FROM g) SELECT event_type, total >= 1001 AND n >= 0.8 * total AND n < total AS applies FROM g, t")
def run_len_policy(spark, d):
    df = table(spark, d, "events", "event_type").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.sum("n").alias("total"))
    return df.crossJoin(F.broadcast(total)).select("event_type", sizes.run_length_applies(F.col("total"), F.col("n")).alias("applies"))


# -- deltas ----------------------------------------------------------------------------


def _delta_sql(order: int) -> str:
    sql, last = EVP, "ts"
    for i in range(order):
        sql += f", d{i} AS (SELECT *, {last} - lag({last}) OVER (PARTITION BY chunk_id, page_id ORDER BY pos) AS x{i} FROM {'pg' if not i else f'd{i - 1}'})"
        last = f"x{i}"
    return f"{sql} SELECT event_id, {last} AS delta FROM d{order - 1} WHERE {last} IS NOT NULL"


def _delta_query(order: int):
    return lambda spark, d: delta.deltas(paged(events(spark, d)), "ts", order).select("event_id", "delta")


for _k in range(1, 8):
    query(_delta_sql(_k), f"delta_order{_k}")(_delta_query(_k))


@query(f"{EVP}, d AS (SELECT *, ts - lag(ts) OVER (PARTITION BY chunk_id, page_id ORDER BY pos) AS x FROM pg) SELECT chunk_id, page_id, arg_min(ts, pos) AS moment0, coalesce(arg_min(x, pos) FILTER (x IS NOT NULL), 0) AS moment1 FROM d GROUP BY ALL")
def delta_moments(spark, d):
    return delta.moments(paged(events(spark, d)), "ts", 2)


@query(f"{EV} SELECT event_id, ts FROM ev")
def undelta_order1(spark, d):
    df = paged(events(spark, d))
    w = Window.partitionBy("chunk_id", "page_id").orderBy("pos")
    df = df.withColumn("delta", bits.wrapping_sub(F.col("ts"), F.lag("ts").over(w))).withColumn("moment", F.first("ts").over(w)).drop("ts")
    return delta.undelta(df, "delta", "moment", out="ts").select("event_id", "ts")


@query(f"""{EVP}, l AS (SELECT event_id, user_id, {', '.join(f'lag(user_id, {i}) OVER w AS l{i}' for i in range(1, 7))} FROM pg WINDOW w AS (PARTITION BY chunk_id, page_id ORDER BY pos)),
u AS ({' UNION ALL '.join(f'SELECT event_id, abs(user_id - l{i}) AS size, {i} AS lookback FROM l WHERE l{i} IS NOT NULL' for i in range(1, 7))})
SELECT event_id, size, lookback FROM u QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY size, lookback) = 1""")
def best_fixed_lookback(spark, d):
    return delta.best_fixed_lookback(paged(events(spark, d)), "user_id").select("event_id", "size", "lookback")


@query(f"""{EVP}, s AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY chunk_id, page_id ORDER BY pos) THEN 0 ELSE 1 END AS s FROM pg),
r AS (SELECT *, sum(s) OVER (PARTITION BY chunk_id, page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM s)
SELECT chunk_id, page_id, event_type, min(pos) AS start_pos, count(*) AS run_length FROM r GROUP BY chunk_id, page_id, run, event_type""")
def run_lengths(spark, d):
    return delta.runs(paged(events(spark, d)), "event_type", ("chunk_id", "page_id"))


@query(f"{EVP}, x AS (SELECT event_id, (event_type = 'error') <> lag(event_type = 'error') OVER (PARTITION BY chunk_id, page_id ORDER BY pos) AS delta FROM pg) SELECT event_id, delta FROM x WHERE delta IS NOT NULL")
def bool_xor_delta(spark, d):
    df = paged(events(spark, d)).withColumn("flag", F.col("event_type") == "error")
    return delta.xor_delta(df, "flag", ("chunk_id", "page_id")).select("event_id", "delta")


@query("SELECT CAST(sum(user_id) AS BIGINT) AS total, count(user_id) AS n FROM events")
def streaming_sum(spark, d):
    return delta.streaming_sum(table(spark, d, "events", "user_id"), "user_id")


def _ranked(spark, d) -> DataFrame:
    df = paged(events(spark, d))
    parts = []
    for order in range(4):
        some = delta.deltas(df, "ts", order) if order else df.withColumn("delta", F.col("ts"))
        parts.append(some.groupBy("chunk_id").agg(F.count_distinct("delta").alias("n_values"), F.max(bits.bit_length(F.abs("delta"))).alias("most_bits")).withColumn("delta_order", F.lit(order)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ranked_sql() -> str:
    sql, last, parts = EVP, "ts", []
    for i in range(4):
        if i:
            sql += f", d{i} AS (SELECT *, {last} - lag({last}) OVER (PARTITION BY chunk_id, page_id ORDER BY pos) AS x{i} FROM {'pg' if i == 1 else f'd{i - 1}'})"
            last = f"x{i}"
        parts.append(f"SELECT chunk_id, count(DISTINCT {last}) AS n_values, max({LEN.format(f'abs({last})')}) AS most_bits, {i} AS delta_order FROM {f'd{i}' if i else 'pg'} WHERE {last} IS NOT NULL GROUP BY chunk_id")
    return sql + " " + " UNION ALL ".join(parts)


query(_ranked_sql(), "delta_order_ranking")(_ranked)


# -- histograms, bins and bids ------------------------------------------------------------


NT = f"{EVP}, o AS (SELECT chunk_id, event_id, {F64.format('value')} AS ord FROM pg), t AS (SELECT *, ntile(16) OVER (PARTITION BY chunk_id ORDER BY ord, event_id) AS bin FROM o), h AS (SELECT chunk_id, bin, min(ord) AS lower, max(ord) AS upper, count(*) AS n FROM t GROUP BY ALL)"


def _values(spark, d) -> DataFrame:
    df = paged(events(spark, d)).select("chunk_id", "event_id", "pos", "value")
    return df.withColumn("ord", numbers.f64_to_ord(F.col("value")))


def _hist(spark, d) -> DataFrame:
    return profile.ntile_histogram(_values(spark, d), "ord", "event_id", 4)


@query(f"{NT} SELECT * FROM h")
def hist_ntile(spark, d):
    return _hist(spark, d)


# The histogram of equal-count bins that never split equal values, as a walk from
# one bin's nominal end to the next over the runs of equal values.
EXACT = f"""{EVP.replace("WITH", "WITH RECURSIVE", 1)}, o AS (SELECT chunk_id, {F64.format('value')} AS ord FROM pg WHERE value IS NOT NULL),
s AS (SELECT chunk_id, ord, row_number() OVER (PARTITION BY chunk_id ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY chunk_id) AS n FROM o),
r AS (SELECT chunk_id, ord, min(i) AS lo, max(i) + 1 AS hi, any_value(n) AS n FROM s GROUP BY chunk_id, ord),
w(chunk_id, n, here, opened, free, ends) AS (SELECT chunk_id, any_value(n), 0::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM r GROUP BY chunk_id
  UNION ALL SELECT chunk_id, n, hi, CASE WHEN ending THEN hi WHEN opening THEN l ELSE opened END, CASE WHEN ending THEN own + 1 WHEN opening THEN mid ELSE free END,
    list_concat(ends, list_concat(CASE WHEN opening THEN [l] ELSE [] END, CASE WHEN ending THEN [hi] ELSE [] END))
  FROM (SELECT *, hi >= ((own + 1) * n + 15) // 16 AS ending FROM (SELECT *, mid > free AND l > opened AS opening, CASE WHEN mid > free AND l <= opened THEN mid - 1 ELSE mid END AS own
    FROM (SELECT w.*, r.hi, greatest(w.here, r.lo) AS l, ((greatest(w.here, r.lo) + (r.hi - greatest(w.here, r.lo)) // 2) * 16) // w.n AS mid
      FROM w JOIN r ON r.chunk_id = w.chunk_id AND r.lo < ((w.here * 16 // w.n + 1) * w.n + 15) // 16 AND r.hi >= ((w.here * 16 // w.n + 1) * w.n + 15) // 16
      WHERE w.here < w.n AND ((w.here * 16 // w.n + 1) * w.n + 15) // 16 < w.n)))),
z AS (SELECT chunk_id, arg_max(CASE WHEN opened < n THEN list_append(ends, n) ELSE ends END, here) AS ends FROM w GROUP BY chunk_id),
b AS (SELECT chunk_id, unnest(range(len(ends))) AS bin, unnest(ends) AS e, unnest(list_prepend(0::BIGINT, ends[:-2])) AS a FROM z)
SELECT b.chunk_id, CAST(bin AS INTEGER) AS bin, x.ord AS lower, y.ord AS upper, e - a AS n FROM b JOIN s x ON x.chunk_id = b.chunk_id AND x.i = a JOIN s y ON y.chunk_id = b.chunk_id AND y.i = e - 1"""


@query(EXACT)
def hist_exact(spark, d):
    """The codec's own histogram of each chunk's values."""
    return profile.exact_histogram(_values(spark, d), "ord", 4)


@query(f"{NT}, r AS (SELECT event_id, row_number() OVER (PARTITION BY chunk_id ORDER BY ord, event_id) - 1 AS rank, count(*) OVER (PARTITION BY chunk_id) AS n FROM o) SELECT event_id, (rank << 4) // n AS bin FROM r")
def hist_bin_idx(spark, d):
    w = Window.partitionBy("chunk_id")
    df = _values(spark, d).withColumn("rank", F.row_number().over(w.orderBy("ord", "event_id")).cast("long") - 1).withColumn("n", F.count(F.lit(1)).over(w))
    return df.select("event_id", profile.bin_index(F.col("rank"), F.col("n"), 4).alias("bin"))


@query(f"{NT}, a AS (SELECT o.event_id, o.ord, h.bin, h.lower FROM o ASOF JOIN (SELECT chunk_id, lower, max(bin) AS bin FROM h GROUP BY ALL) h ON o.chunk_id = h.chunk_id AND o.ord >= h.lower) SELECT event_id, bin, ord - lower AS offset FROM a")
def assign_bins(spark, d):
    df = profile.assign_bins(_values(spark, d), _hist(spark, d), "ord")
    return df.select("event_id", "bin", "offset")


@query(f"{EVP} SELECT chunk_id, min(ts) AS min_ord, max(ts) AS max_ord, count(*) AS n FROM pg GROUP BY 1")
def chunk_min_max(spark, d):
    return profile.min_max(paged(events(spark, d)), "ts", "chunk_id")


@query(f"{NT}, t2 AS (SELECT chunk_id, sum(n) AS total FROM h GROUP BY 1) SELECT chunk_id, bin, round(81 + (log2(total) - log2(n) + {LEN.format('(upper - lower)')}) * n, 4) AS cost FROM h JOIN t2 USING (chunk_id)")
def bin_cost(spark, d):
    df = _hist(spark, d)
    df = df.withColumn("total", F.sum("n").over(Window.partitionBy("chunk_id")))
    return df.select("chunk_id", "bin", F.round(profile.bin_cost(F.col("n"), F.col("lower"), F.col("upper"), F.col("total"), 81), 4).alias("cost"))


# Bins of 2^8 total weight: 15 of weight 16 and one that takes the rest.
BINS = f"{NT}, w AS (SELECT chunk_id, bin, n, 16 AS weight, 8 AS size_log, {LEN.format('(upper - lower)')} AS offset_bits FROM h)"


def _bins(spark, d) -> DataFrame:
    df = _hist(spark, d)
    return df.select("chunk_id", "bin", "n", "lower", "upper", F.lit(16).alias("weight"), F.lit(8).alias("size_log"), bits.bit_length(bits.wrapping_sub(F.col("upper"), F.col("lower"))).alias("offset_bits"))


@query(f"{BINS} SELECT chunk_id, round(sum(weight / 256.0 * (size_log - log2(weight) + offset_bits)), 6) AS avg_bits FROM w GROUP BY 1")
def avg_bits_per_latent(spark, d):
    return _bins(spark, d).groupBy("chunk_id").agg(F.round(profile.average_bits(F.col("weight"), F.col("size_log"), F.col("offset_bits")), 6).alias("avg_bits"))


@query(f"{BINS} SELECT chunk_id, CAST(sum(n * (offset_bits + size_log - 4)) AS BIGINT) AS worst_bits FROM w GROUP BY 1")
def worst_case_bits(spark, d):
    return _bins(spark, d).groupBy("chunk_id").agg(profile.worst_bits(F.col("n"), F.col("weight"), F.col("size_log"), F.col("offset_bits")).alias("worst_bits"))


@query(f"{BINS} SELECT chunk_id, CAST((27 + 16 * 79 + 7) // 8 + (sum(n * (offset_bits + size_log - 4)) + 7) // 8 > 13 + sum(n) * 8 AS BOOLEAN) AS falls_back FROM w GROUP BY 1")
def fallback_decision(spark, d):
    worst = profile.worst_bits(F.col("n"), F.col("weight"), F.col("size_log"), F.col("offset_bits"))
    df = _bins(spark, d).groupBy("chunk_id").agg(worst.alias("worst"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("bins"))
    meta = F.ceil(sizes.chunk_meta_bits(F.lit(8), F.col("bins"), 64) / 8)
    return df.select("chunk_id", (meta + F.ceil(F.col("worst") / 8) > sizes.wrapped_guarantee(F.col("n"), 64)).alias("falls_back"))


@query(f"{BINS} SELECT chunk_id, max(offset_bits) AS max_offset_bits, count(*) = 0 OR (count(*) = 1 AND max(offset_bits) = 0) AS trivial FROM w GROUP BY 1")
def max_offset_bits(spark, d):
    df = _bins(spark, d).groupBy("chunk_id").agg(F.max("offset_bits").alias("max_offset_bits"), F.count(F.lit(1)).alias("n"))
    return df.select("chunk_id", "max_offset_bits", ((F.col("n") == 1) & (F.col("max_offset_bits") == 0)).alias("trivial"))


@query(f"{NT}, c AS (SELECT chunk_id, bin, CAST(sum(n) OVER (PARTITION BY chunk_id ORDER BY bin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS c_count FROM h) SELECT * FROM c")
def bin_cumulative_counts(spark, d):
    w = Window.partitionBy("chunk_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _hist(spark, d).select("chunk_id", "bin", F.sum("n").over(w).alias("c_count"))


@query(f"{NT} SELECT chunk_id, min(lower) AS min_ord, max(upper) AS max_ord, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY 1")
def metadata_min_max(spark, d):
    return _hist(spark, d).groupBy("chunk_id").agg(F.min("lower").alias("min_ord"), F.max("upper").alias("max_ord"), F.sum("n").alias("n"))


@query("""WITH b AS (SELECT (l_quantity::BIT)::BIGINT AS b FROM lineitem), z AS (SELECT CASE WHEN b = 0 THEN 52 ELSE least(52, length(bin(b & -b)) - 1) END AS zeros, count(*) AS n FROM b GROUP BY 1)
SELECT zeros, n, CAST(sum(n) OVER (ORDER BY zeros DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS at_least FROM z""")
def trailing_zero_cum_hist(spark, d):
    df = table(spark, d, "lineitem", "l_quantity").select(numbers.float_trailing_zeros(F.col("l_quantity")).alias("zeros"))
    return delta.reverse_cumulative(df.groupBy("zeros").agg(F.count(F.lit(1)).alias("n")), "zeros", "n")


@query("""WITH g AS (SELECT CAST(round(o_totalprice) AS BIGINT) AS p, count(*) AS n, count(*) * 6.5 AS saved FROM orders GROUP BY 1), t AS (SELECT sum(n) AS total FROM g)
SELECT round(sum(CASE WHEN n <= greatest(1, total // 256) THEN saved ELSE 0.0 END) / max(total), 6) AS bits_saved FROM g, t""")
def bits_saved_estimate(spark, d):
    df = table(spark, d, "orders", "o_totalprice").select(F.round("o_totalprice").cast("long").alias("p"), F.lit(6.5).alias("saved"))
    return profile.savings(df, "p", "saved").select(F.round("bits_saved", 6).alias("bits_saved"))


@query("""WITH b AS (SELECT l_returnflag, 'classic' AS mode, 0.0::DOUBLE AS bits_saved, 0 AS bid_no FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'float_mult', round(log2(count(DISTINCT l_extendedprice)), 3), 1 FROM lineitem GROUP BY 1
UNION ALL SELECT l_returnflag, 'float_quant', round(log2(count(DISTINCT l_quantity)), 3), 2 FROM lineitem GROUP BY 1)
SELECT l_returnflag, arg_max(mode, (bits_saved, bid_no)) AS mode, max(bits_saved) AS bits_saved FROM b GROUP BY 1""")
def winning_bid(spark, d):
    g = table(spark, d, "lineitem", "l_returnflag", "l_extendedprice", "l_quantity").groupBy("l_returnflag").agg(F.count_distinct("l_extendedprice").alias("a"), F.count_distinct("l_quantity").alias("b"))
    bid = lambda mode, saved, no: F.struct(F.lit(mode).alias("mode"), saved.alias("bits_saved"), F.lit(no).alias("bid_no"))
    all_ = F.array(bid("classic", F.lit(0.0), 0), bid("float_mult", F.round(F.log2("a"), 3), 1), bid("float_quant", F.round(F.log2("b"), 3), 2))
    return profile.winning_bid(g.select("l_returnflag", F.explode(all_).alias("x")).select("l_returnflag", "x.*"), "l_returnflag")


@query(f"{LI}, m AS (SELECT l_linenumber, min(l_shipdate) AS low FROM li GROUP BY 1) SELECT l_linenumber, list_reduce(list(DISTINCT l_shipdate - low), lambda a, b: gcd(a, b)) AS gcd FROM li JOIN m USING (l_linenumber) GROUP BY 1")
def range_gcd(spark, d):
    df = table(spark, d, "lineitem", "l_linenumber", "l_shipdate").withColumn("l_shipdate", numbers.timestamp_micros(F.col("l_shipdate")))
    return profile.range_gcd(df, "l_shipdate", "l_linenumber")


# -- reports ------------------------------------------------------------------------------


RUNS = """r AS (SELECT l_returnflag AS input, l_linestatus AS codec, l_quantity AS compress_dt, l_tax AS decompress_dt, l_partkey AS compressed_size FROM lineitem),
m AS (SELECT input, codec, median(compress_dt) AS compress_dt, median(decompress_dt) AS decompress_dt, max(compressed_size) AS compressed_size FROM r GROUP BY ALL)"""


def _runs(spark, d) -> DataFrame:
    df = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_tax", "l_partkey")
    return df.toDF("input", "codec", "compress_dt", "decompress_dt", "compressed_size")


@query(f"WITH {RUNS} SELECT * FROM m")
def bench_median(spark, d):
    return report.median_runs(_runs(spark, d))


@query(f"WITH {RUNS} SELECT coalesce(codec, '<sum>') AS codec, round(sum(compress_dt), 6) AS compress_dt, round(sum(decompress_dt), 6) AS decompress_dt, CAST(sum(compressed_size) AS BIGINT) AS compressed_size FROM m GROUP BY ROLLUP (codec)")
def bench_rollup(spark, d):
    df = report.rollup_runs(report.median_runs(_runs(spark, d)))
    return df.select("codec", F.round("compress_dt", 6).alias("compress_dt"), F.round("decompress_dt", 6).alias("decompress_dt"), "compressed_size")


@query(f"""WITH {RUNS}, o AS (SELECT * FROM m WHERE codec = 'O'), n AS (SELECT input, codec, CASE WHEN input = 'A' THEN NULL ELSE compress_dt + 1 END AS compress_dt, decompress_dt, compressed_size FROM m)
SELECT input, codec, coalesce(n.compress_dt, o.compress_dt) AS compress_dt, coalesce(n.decompress_dt, o.decompress_dt) AS decompress_dt, coalesce(n.compressed_size, o.compressed_size) AS compressed_size FROM o FULL JOIN n USING (input, codec)""")
def results_upsert(spark, d):
    m = report.median_runs(_runs(spark, d))
    new = m.withColumn("compress_dt", F.when(F.col("input") == "A", F.lit(None)).otherwise(F.col("compress_dt") + 1))
    return report.upsert_results(m.where("codec = 'O'"), new)


@query(f"{EVP}, p AS (SELECT chunk_id, page_id, count(*) AS n, 20 + count(*) * 3 AS page_bytes, 16 AS meta_bytes FROM pg GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * 8) AS BIGINT) AS uncompressed_size, CAST(sum(meta_bytes + page_bytes) AS BIGINT) AS compressed_size, round(sum(n * 8) / sum(meta_bytes + page_bytes), 6) AS ratio FROM p")
def inspect_totals(spark, d):
    pages = paged(events(spark, d)).groupBy("chunk_id", "page_id").agg(F.count(F.lit(1)).alias("n")).withColumn("page_bytes", 20 + F.col("n") * 3).withColumn("meta_bytes", F.lit(16))
    return report.inspect_totals(pages, 8)


@query(f"{BINS} SELECT chunk_id, 'primary' AS latent_var, count(*) AS n_bins, max(size_log) AS ans_size_log, round(sum(weight / 256.0 * (size_log - log2(weight) + offset_bits)), 6) AS approx_avg_bits FROM w GROUP BY 1")
def latent_var_summary(spark, d):
    return report.latent_var_summary(_bins(spark, d).withColumn("latent_var", F.lit("primary")))


# -- the flagship -----------------------------------------------------------------------------


FLAGSHIP = f"""{ODP}, x AS (SELECT chunk_id, page_id, o_custkey - lag(o_custkey) OVER (PARTITION BY chunk_id, page_id ORDER BY pos) AS d FROM pg),
b AS (SELECT chunk_id, page_id, {LEN.format('abs(d)')} AS n_bits FROM x WHERE d IS NOT NULL),
k AS (SELECT chunk_id, page_id, n_bits, count(*) AS n FROM b GROUP BY ALL), c AS (SELECT *, sum(n) OVER (PARTITION BY chunk_id, page_id) AS total FROM k)
SELECT chunk_id, page_id, CAST(sum(n) AS BIGINT) AS n, round(sum(n * (n_bits + log2(total / n))) / sum(n), 4) AS bits_per_number FROM c GROUP BY ALL"""


@query(FLAGSHIP, "page_bits_estimate")
def flagship(spark, d):
    """Bits per number of each page: order-1 deltas, a histogram of their bit
    lengths, the entropy of the lengths plus the bits themselves."""
    df = delta.deltas(paged(orders(spark, d)), "o_custkey", 1)
    n_bits = bits.bit_length(F.abs("delta"))
    c = df.select("chunk_id", "page_id", n_bits.alias("n_bits")).groupBy("chunk_id", "page_id", "n_bits").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("total", F.sum("n").over(Window.partitionBy("chunk_id", "page_id")))
    cost = F.col("n") * (F.col("n_bits") + F.log2(F.col("total") / F.col("n")))
    return c.groupBy("chunk_id", "page_id").agg(F.sum("n").alias("n"), F.round(F.sum(cost) / F.sum("n"), 4).alias("bits_per_number"))
