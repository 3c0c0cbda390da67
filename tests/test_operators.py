"""Edge cases of scalar functions and operators."""
import pytest
from pyspark.sql import functions as F

from tessera.functions import bits, numbers, sizes
from tessera.operators import delta, layout, profile, report

LOW, TOP = -(2**63), 2**63 - 1


def wrapped(x):
    return (x + 2**63) % 2**64 - 2**63


def test_wrapping_arithmetic(spark):
    pairs = [(a, b) for a in (LOW, -1, 0, 1, 5, TOP, 2**32, -(2**32) - 1) for b in (LOW, -1, 0, 1, 7, TOP, 2**31)]
    df = spark.createDataFrame(pairs, "a long, b long")
    for r in df.select("a", "b", bits.wrapping_sub(F.col("a"), F.col("b")).alias("d"), bits.wrapping_add(F.col("a"), F.col("b")).alias("s")).collect():
        assert (r["d"], r["s"]) == (wrapped(r["a"] - r["b"]), wrapped(r["a"] + r["b"]))


def test_float_ords_keep_order_and_bits(spark):
    xs = [float("-inf"), -1e300, -1.5, -0.0, 0.0, 1e-310, 2.5, float("inf")]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(numbers.f64_to_ord(F.col("x"))).collect()]
    assert got == sorted(got) and len(set(got)) == len(got)
    back = [r[0] for r in df.select(numbers.ord_to_f64(numbers.f64_to_ord(F.col("x")))).collect()]
    assert [str(x) for x in back] == [str(x) for x in xs]


@pytest.mark.parametrize("base", [1, 2, 7, 10**9, 2**64 - 1])
def test_int_mult_of_extremes(spark, base):
    df = spark.createDataFrame([(x,) for x in (LOW, -1, 0, 5, TOP)], "x long")
    mult, adj = numbers.int_mult_split(F.col("x"), base)
    for r in df.select("x", mult.alias("m"), adj.alias("a")).collect():
        assert divmod(r["x"] + 2**63, base) == (int(r["m"]), int(r["a"]))


def test_gcds(spark):
    pairs = [(0, 0, 0), (0, 1, 1), (1, 0, 1), (2, 0, 2), (2, 3, 1), (6, 3, 3), (12, 30, 6)]
    df = spark.createDataFrame(pairs, "a long, b long, g long")
    assert df.where(numbers.pair_gcd(F.col("a"), F.col("b")) != F.col("g")).count() == 0
    assert spark.createDataFrame([(None, 4)], "a long, b long").select(numbers.pair_gcd(F.col("a"), F.col("b"))).first()[0] is None


def test_sizes(spark):
    df = spark.createDataFrame([(1,), (9,), (10,), (100,), (1_000_010,)], "n long")
    assert [r[0] for r in df.select(sizes.sample_size(F.col("n"))).collect()] == [None, None, 10, 12, 25_010]


def test_pages_follow_the_definition(spark):
    for n in (1, 5, 17, 40):
        for most in (1, 3, 7, 50):
            k = -(-n // most)
            want = [next(i for i in range(k) if p < (i + 1) * n // k) for p in range(n)]
            df = spark.range(n).select("id", layout.page_of(F.col("id"), F.lit(n), most).alias("p")).orderBy("id")
            assert [r["p"] for r in df.collect()] == want


def test_positions_of_unsorted_rows_and_none(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert layout.with_position(df, "k").where("pos <> k").count() == 0
    assert layout.with_position(df.where("k < 0"), "k").count() == 0


def test_short_pages_have_zero_moments(spark):
    df = spark.createDataFrame([(0, 0, 0, 5), (1, 0, 0, 7), (1, 0, 1, 9)], "chunk_id long, page_id long, pos long, x long")
    got = {r["chunk_id"]: (r["moment0"], r["moment1"], r["moment2"]) for r in delta.moments(df, "x", 3).collect()}
    assert got == {0: (5, 0, 0), 1: (7, 2, 0)}


def test_runs_with_nulls(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["a", "a", None, None, "a"])], "pos long, v string").withColumn("g", F.lit(0))
    got = sorted((r["start_pos"], r["v"], r["run_length"]) for r in delta.runs(df, "v", ("g",)).collect())
    assert got == [(0, "a", 2), (2, None, 2), (4, "a", 1)]


def test_columns_and_filters(spark):
    df = spark.createDataFrame([("ab",), ("cd",), ("ef",)], "name string")
    assert report.name_contains(df, "name", []).count() == 0
    assert report.column_of(df) == report.column_of(df, index=0) == report.column_of(df, "name") == "name"
    with pytest.raises(ValueError):
        report.column_of(df.withColumn("b", F.lit(1)))


def test_values_below_all_bins(spark):
    bins = spark.createDataFrame([(0, 1, 10), (0, 2, 20)], "chunk_id long, bin int, lower long")
    df = spark.createDataFrame([(0, 5), (0, 10), (0, 19), (0, 99)], "chunk_id long, ord long")
    assert {r["ord"]: r["bin"] for r in profile.assign_bins(df, bins, "ord").collect()} == {5: 1, 10: 1, 19: 1, 99: 2}
