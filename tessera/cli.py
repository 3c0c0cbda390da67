"""``python -m tessera``: compress, decompress, inspect and bench on files.

Every command starts a Spark session, so inputs may be anything Spark reads."""
import argparse
import json
import os
import sys

from .errors import InvalidArgumentError


def _session():
    from pyspark.sql import SparkSession

    from .runtime import ready

    spark = SparkSession.builder.appName("tessera").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ready(spark)


def _input(spark, path: str, args):
    """(DataFrame, column) of an input file."""
    from .operators.report import column_of
    from .sources import files

    kind = files.format_of(path, args.input_format)
    if kind == "csv":
        df = spark.read.csv(path, header=not args.no_header, sep=args.sep, inferSchema=True, samplingRatio=0.1)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        ntype = args.dtype or (files.binary_name(path)[1].name if kind == "binary" else None)
        if kind == "standalone" and not ntype:
            ntype = _standalone_type(spark, path)
        df = files.scan(spark, path, kind, files.dtype_named(ntype or "i16").name).select("x")
    return df, column_of(df, args.col_name, args.col_idx) if len(df.columns) > 1 or args.col_name else df.columns[0]


def compress(args) -> int:
    from .sources import columns, datasource

    spark = _session()
    datasource.register(spark)
    df, col = _input(spark, args.input, args)
    x = df.select(columns.plain(df, col).alias("x")).coalesce(1)
    mode = "overwrite" if args.overwrite else "append"
    options = {"level": args.level, "mode": args.mode, "delta": args.delta, "chunkN": args.chunk_n} | ({"ntype": args.dtype} if args.dtype else {})
    x.write.format("tessera").options(**options).mode(mode).save(args.output)
    return 0


def decompress(args) -> int:
    """Numbers of standalone files in their order: printed, or written as text (one
    a line) or as raw little-endian numbers."""
    from .sources import datasource, files

    spark = _session()
    ntype = args.dtype or _standalone_type(spark, args.input)
    df = files.in_order(files.scan(spark, args.input, "standalone", files.dtype_named(ntype).name))
    if args.limit is not None:
        df = df.where(df["pos"] < args.limit)
    if args.output is None:
        for r in df.orderBy("pos").toLocalIterator():
            print(r["x"])
    elif args.output_format == "binary":
        datasource.register(spark)
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartitionByRange(n, "pos").sortWithinPartitions("pos").select("x").write.format("tessera").options(raw="true", ntype=ntype).mode("append").save(args.output)
    else:
        files.write_text(df, args.output)
    return 0


def _standalone_type(spark, path: str) -> str:
    """The number type of the first file, from its first bytes."""
    from pyspark.sql import functions as F

    from . import standalone

    first = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 64).alias("head")).first()[0]
    t = standalone.FileReader(bytes(first)).peek()
    return t.name if t else "i64"


def inspect(args) -> int:
    """Per file: type, chunks with mode, delta and bins, and the totals, as JSON."""
    from . import standalone
    from .kernel.describe import describe

    spark, out = _session(), []
    for r in spark.read.format("binaryFile").load(args.input).select("path", "content").toLocalIterator():
        reader, chunks = standalone.FileReader(bytes(r["content"])), []
        head, t = reader.at, reader.peek()
        for x, meta, meta_size, page_size in reader.chunks():
            chunks.append({"n": len(x), "mode": meta.mode.kind, "base": meta.mode.base, "k": meta.mode.k, "delta": meta.delta.kind, "order": meta.delta.order, "meta_size": meta_size, "page_size": page_size,
                           "latent_vars": {v: {"name": describe(meta)[v].name, "unit": describe(meta)[v].unit, "n_bins": len(b), "ans_size_log": b.size_log, "approx_avg_bits": round(b.average_bits(), 4)} for v, b in meta.bins.items()}})
        n = sum(c["n"] for c in chunks)
        plain, packed = n * (t.dtype.itemsize if t else 0), len(r["content"])
        out.append({"file": os.path.basename(r["path"]), "number_type": t.name if t else None, "format_version": reader.format, "n_chunks": len(chunks), "n": n, "uncompressed_size": plain,
                    "compressed_size": packed, "header_size": head, "footer_size": 1, "ratio": round(plain / packed, 4), "chunks": chunks})
    print(json.dumps(out, indent=1))
    return 0


def bench(args) -> int:
    from pyspark.sql import functions as F

    from .operators import report
    from .sources import bench as B
    from .sources import columns

    spark = _session()
    df = spark.read.parquet(args.input)
    names = [c for c in df.columns if type(df.schema[c].dataType) in columns.BY_SPARK and (not args.datasets or any(d in c for d in args.datasets.split(",")))]
    cols = {c: columns.ntype_of(df, c) for c in names}
    df = df.select(F.monotonically_increasing_id().alias("__k"), *[columns.plain(df, c).alias(c) for c in names])
    runs = B.run_codecs(df, cols, "__k", args.codecs.split(","), iters=args.iters)
    medians = report.median_runs(runs)
    if args.results:
        medians = _upserted(spark, args.results, medians)
    medians = medians.orderBy("input", "codec")
    medians.show(1000, False)
    report.rollup_runs(medians).orderBy("codec").show(100, False)
    return 0


def _upserted(spark, path: str, new):
    """Results of earlier runs with the new ones over them, written back as CSV: a
    row for each input and codec, so a small table."""
    import csv

    from .operators import report

    schema = "input string, codec string, compress_dt double, decompress_dt double, compressed_size long"
    if os.path.exists(path):
        new = report.upsert_results(spark.read.csv(path, header=True, schema=schema), new)
    rows = sorted(tuple(r) for r in new.collect())
    made = f"{path}.new"
    with open(made, "w", newline="") as f:
        csv.writer(f).writerows([new.columns, *rows])
    os.replace(made, path)
    return spark.createDataFrame(rows, schema)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name, run, with_input=True):
        s = sub.add_parser(name)
        s.set_defaults(run=run)
        s.add_argument("--input", required=with_input)
        s.add_argument("--input-format")
        s.add_argument("--dtype")
        s.add_argument("--col-name")
        s.add_argument("--col-idx", type=int)
        s.add_argument("--no-header", action="store_true")
        s.add_argument("--sep", default=",")
        return s

    s = add("compress", compress)
    s.add_argument("output")
    s.add_argument("--level", type=int, default=8)
    s.add_argument("--mode", default="auto")
    s.add_argument("--delta", default="auto")
    s.add_argument("--chunk-n", type=int, default=1 << 18)
    s.add_argument("--overwrite", action="store_true")
    s = add("decompress", decompress)
    s.add_argument("--limit", type=int)
    s.add_argument("--output")
    s.add_argument("--output-format", choices=("text", "binary"), default="text")
    add("inspect", inspect)
    s = add("bench", bench)
    s.add_argument("--codecs", default="tessera,parquet,zstd")
    s.add_argument("--datasets")
    s.add_argument("--results", help="CSV of results that the new ones are merged into")
    s.add_argument("--iters", type=int, default=10)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except InvalidArgumentError as e:
        print(e, file=sys.stderr)
        return 2
