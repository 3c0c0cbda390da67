"""Files, the page table, the data source and streams."""
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import standalone
from tessera.errors import CodecError, CorruptionError, InvalidArgumentError
from tessera.kernel.config import ChunkConfig, Paging
from tessera.sources import bench, columns, datasource, files
from tessera.streaming import decoder, sink


def test_page_table(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 3 % 101 - 50).alias("v"))
    columns.write(df, str(tmp_path / "t"), "v", "k", chunk_n=1000, options=columns.config(page_n=100))
    pages = spark.read.parquet(str(tmp_path / "t"))
    assert pages.count() == 50 and pages.select("chunk_id").distinct().count() == 5
    back = columns.decompress(pages, "i64").join(df, F.col("pos") == F.col("k"))
    assert back.count() == 5000 and back.where("x <> v").count() == 0
    some = columns.decompress(pages, "i64", -10, 10)
    assert some.count() == df.where("v >= -10 AND v < 10").count()
    info = columns.chunk_info(pages).collect()
    assert sum(r["n"] for r in info) == 5000 and columns.bin_rows(pages).count() >= 5


def test_pruning_reaches_the_scan(spark, tmp_path):
    df = spark.range(1000).withColumnRenamed("id", "k")
    columns.write(df, str(tmp_path / "t"), "k", "k", options=columns.config(page_n=100))
    plan = columns.decompress(spark.read.parquet(str(tmp_path / "t")), "i64", 5, 9)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(max_ord,5)" in plan and "LessThan(min_ord,9)" in plan


def test_nulls_and_types(spark):
    df = spark.createDataFrame([(0, 1.5, "a"), (1, None, "b"), (2, 2.5, "c")], "k long, v double, s string")
    with pytest.raises(Exception, match="null in the column"):
        columns.compress(df, "v", "k").count()
    pages = columns.compress(df, "v", "k", nulls="drop")
    assert [r["x"] for r in columns.decompress(pages, "f64").orderBy("pos").collect()] == [1.5, 2.5]
    with pytest.raises(InvalidArgumentError):
        columns.compress(df, "s", "k")
    assert columns.compress(df.where("k > 9"), "v", "k", nulls="drop").count() == 0


def test_data_source(spark, tmp_path):
    datasource.register(spark)
    path = str(tmp_path / "d")
    df = spark.range(1000).select((F.col("id") % 17).cast("int").alias("x"))
    df.coalesce(1).write.format("tessera").option("chunkN", 300).option("delta", "none").mode("append").save(path)
    back = spark.read.format("tessera").load(path)
    assert back.dtypes == [("pos", "bigint"), ("x", "int")]
    assert [r["x"] for r in back.orderBy("pos").collect()] == [i % 17 for i in range(1000)]
    df.limit(5).coalesce(1).write.format("tessera").mode("append").save(path)
    rows = files.in_order(files.scan(spark, f"{path}/*.tcol", "standalone", "i32")).orderBy("pos").collect()
    assert [(r["pos"], r["x"]) for r in rows] == [(i, i % 17 if i < 1000 else i - 1000) for i in range(1005)]
    df.coalesce(1).write.format("tessera").option("raw", "true").mode("append").save(str(tmp_path / "r"))
    assert [r["x"] for r in files.scan(spark, str(tmp_path / "r"), "binary", "i32").orderBy("pos").collect()] == [i % 17 for i in range(1000)]
    df.limit(10).coalesce(1).write.format("tessera").mode("overwrite").save(path)
    assert spark.read.format("tessera").load(path).count() == 10
    before = sorted(os.listdir(path))
    with pytest.raises(Exception, match="a null in the column"):
        df.withColumn("x", F.when(F.col("x") < 16, F.col("x"))).coalesce(1).write.format("tessera").mode("overwrite").save(path)
    assert sorted(os.listdir(path)) == before


def test_file_scans(spark, tmp_path):
    x = np.array([1.5, -2.5, 3.0])
    (tmp_path / "f64_price.bin").write_bytes(x.tobytes())
    (tmp_path / "a.tcol").write_bytes(standalone.compress(x, ChunkConfig(paging=Paging(2))))
    assert [r["x"] for r in files.scan(spark, str(tmp_path / "f64_price.bin"), "binary", "f64").orderBy("pos").collect()] == x.tolist()
    assert [r["x"] for r in files.scan(spark, str(tmp_path / "a.tcol"), "standalone", "f64").orderBy("pos").collect()] == x.tolist()
    assert files.binary_name("x/f64_price.bin")[0] == "price" and files.format_of("x.WAV") == "wav"
    with pytest.raises(InvalidArgumentError):
        files.format_of("x.zip")
    with pytest.raises(InvalidArgumentError):
        files.dtype_named("decimal")
    assert files.dtype_named("Micros").name == "i64"


def test_wav_channels(spark, tmp_path):
    body = struct.pack("<6h", 1, -1, 2, -2, 3, -3)
    head = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 2, 8000, 32000, 4, 16) + b"data" + struct.pack("<I", len(body))
    (tmp_path / "s.wav").write_bytes(b"RIFF" + struct.pack("<I", len(head) + len(body)) + head + body)
    got = files.scan(spark, str(tmp_path / "s.wav"), "wav", "i16", channel=1).orderBy("pos").collect()
    assert [r["x"] for r in got] == [-1, -2, -3]
    with pytest.raises(CorruptionError):
        files.wav_layout(b"nothing")


def test_directory_is_a_table(spark, tmp_path):
    for name, values in (("b", [1, 2, 3]), ("a", [4, 5, 6])):
        (tmp_path / f"{name}.tcol").write_bytes(standalone.compress(np.array(values)))
    df = files.directory_table(spark, str(tmp_path), {"a": "i64", "b": "i64"})
    assert [tuple(r) for r in df.orderBy("pos").collect()] == [(0, 4, 1), (1, 5, 2), (2, 6, 3)]


def test_text_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5), (0, 1.5)], "pos long, x double")
    files.write_text(df, str(tmp_path / "t"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "t")).collect()] == ["1.5", "2.5"]
    (tmp_path / "c.csv").write_text("a;b\n1;2\n3;4\n")
    assert [r["b"] for r in files.csv_column(spark, str(tmp_path / "c.csv"), "b", sep=";").collect()] == [2.0, 4.0]


def test_codecs_are_lossless():
    x = np.cumsum(np.random.default_rng(1).integers(-5, 6, 2000))
    for name in bench.CODECS:
        assert len(bench.measure(x, name, 2)) == 2


def test_push_decoder_waits_for_whole_items():
    x = np.arange(1000)
    data = standalone.compress(x, ChunkConfig(paging=Paging(400)))
    d, got = decoder.PushDecoder(limit=150), []
    for i in range(0, len(data), 7):
        before = d.buffer
        items = list(d.feed(data[i : i + 7]))
        got += items
        if not items:
            assert d.buffer == before + data[i : i + 7]
    assert [k for k, _ in got if k != "numbers"] == ["header", "chunk", "chunk", "chunk", "footer"]
    assert np.concatenate([v for k, v in got if k == "numbers"]).tolist() == x.tolist()
    with pytest.raises(CodecError):
        list(d.feed(b"x"))


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    df.coalesce(2).write.parquet(str(src))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    sink.write_stream(stream, out, str(tmp_path / "c1"), "v", "k").awaitTermination()
    back = sink.read_batches(spark, out, "i64")
    assert back.count() == 100 and back.agg(F.sum("x")).first()[0] == 9900
    assert back.select("batch", "pos").distinct().count() == 100 and back.select("batch").distinct().count() == 2
    q = sink.running_sum(stream, "v").writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert tuple(spark.table("sums").first()) == (9900, 100)


@pytest.mark.parametrize("ntype, x", [("f64", np.arange(500.0)), ("i64", np.arange(500) * 2 + (1 << 60) + 1), ("u64", np.arange(500, dtype=np.uint64) + np.uint64((1 << 63) + 1))])
def test_decoding_a_stream_of_blobs(spark, tmp_path, ntype, x):
    data = standalone.compress(x, ChunkConfig(paging=Paging(200)))
    rows = [("s", i, bytearray(data[a : a + 100])) for i, a in enumerate(range(0, len(data), 100))]
    df = spark.createDataFrame(rows, "stream_id string, seq long, blob binary")
    for i, part in enumerate((df.where("seq < 2"), df.where("seq >= 2"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = decoder.decode_stream(stream, ntype).writeStream.format("memory").queryName(f"decoded_{ntype}").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table(f"decoded_{ntype}").orderBy("pos").collect()
    assert [r["x"] for r in got] == x.tolist() and [r["pos"] for r in got] == list(range(500))
