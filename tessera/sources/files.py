"""Scans of files that hold one sequence or several, by their bytes.

Files are read with Spark's binaryFile source, so any store that Spark reads
will do; one file is one task, as a standalone file can't be split."""
import os
import struct
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import standalone
from ..errors import CorruptionError, InvalidArgumentError
from ..kernel import numbers as N
from ..runtime import Scratch
from .columns import SPARK, to_arrow

#: Numbers in one batch that a scan hands to Spark.
BATCH_N = 1 << 18
FORMATS = {".csv": "csv", ".parquet": "parquet", ".tcol": "standalone", ".wav": "wav", ".bin": "binary"}
NAMES = {"seconds": "i64", "millis": "i64", "micros": "i64", "nanos": "i64"}


def format_of(path: str, given: str | None = None) -> str:
    """A file's format, by its extension unless given."""
    found = given or FORMATS.get(os.path.splitext(path)[1].lower())
    if not found:
        raise InvalidArgumentError(f"can't tell the format of {path}")
    return found


def dtype_named(name: str) -> N.NumberType:
    """A number type by name, in any case; units of time are i64."""
    name = name.lower()
    return N.TYPES[NAMES.get(name, name)] if NAMES.get(name, name) in N.TYPES else _unknown(name)


def _unknown(name: str):
    raise InvalidArgumentError(f"unknown number type {name!r}")


def binary_name(path: str) -> tuple[str, N.NumberType]:
    """(column, type) of a raw file named ``<type>_<column>.bin``."""
    stem = os.path.splitext(os.path.basename(path))[0]
    kind, _, column = stem.partition("_")
    return column, dtype_named(kind)


def scan(spark: SparkSession, path: str, kind: str, ntype: str, channel: int = 0) -> DataFrame:
    """(file, pos, x) of standalone, raw binary or WAV files of one number type."""
    read = {"standalone": _standalone, "binary": _binary, "wav": _wav}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = N.TYPES[ntype]
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                at = 0
                for x in read(data.as_py(), t, channel):
                    for i in range(0, len(x), BATCH_N):
                        part = x[i : i + BATCH_N]
                        yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at, at + len(part))), to_arrow(part, t)], ["file", "pos", "x"])
                        at += len(part)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, f"file string, pos long, x {SPARK[ntype]}")


def in_order(found: DataFrame) -> DataFrame:
    """A scan with positions that go on from file to file, by name. The rows are
    decoded once; the files' lengths, one number for each listed file, are
    broadcast."""
    kept = Scratch(found.sparkSession, "files").keep(found, "decoded")
    sizes = {r["file"]: r["n"] for r in kept.groupBy("file").agg(F.count(F.lit(1)).alias("n")).collect()}
    starts = list(zip(sorted(sizes), accumulate((sizes[f] for f in sorted(sizes)), initial=0)))
    before = found.sparkSession.createDataFrame(starts, "file string, before long")
    return kept.join(F.broadcast(before), "file").select("file", (F.col("pos") + F.col("before")).alias("pos"), "x")


def _standalone(data: bytes, t: N.NumberType, _: int) -> Iterator[np.ndarray]:
    for x, *_rest in standalone.FileReader(data).chunks(t):
        yield x


def _binary(data: bytes, t: N.NumberType, _: int) -> Iterator[np.ndarray]:
    if len(data) % t.dtype.itemsize:
        raise CorruptionError("not a whole number of values")
    yield np.frombuffer(data, t.dtype.newbyteorder("<")).astype(t.dtype)


def wav_layout(data: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, channels, bits, sample bytes) of a WAV file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise CorruptionError("not a WAV file")
    at, head = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if name == b"fmt ":
            head = struct.unpack_from("<HHIIHH", body)
        elif name == b"data" and head:
            return head[0], head[1], head[5], body
        at += 8 + size + size % 2
    raise CorruptionError("a WAV file without samples")


def _wav(data: bytes, t: N.NumberType, channel: int) -> Iterator[np.ndarray]:
    """One channel: 8 and 16 bits as i16, 24 and 32 bits as i32, floats as f32."""
    tag, channels, bits, body = wav_layout(data)
    if channel >= channels:
        raise InvalidArgumentError(f"no channel {channel}")
    if tag == 3 and bits == 32:
        x = np.frombuffer(body, "<f4")
    elif bits == 24:
        b = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8) >> 8
    elif bits in (8, 16, 32):
        x = np.frombuffer(body, {8: "u1", 16: "<i2", 32: "<i4"}[bits])
    else:
        raise InvalidArgumentError(f"{bits}-bit samples")
    yield x[channel::channels].astype(t.dtype)


def csv_column(spark: SparkSession, path: str, column: str, header: bool = True, sep: str = ",", kind: str = "double") -> DataFrame:
    return spark.read.csv(path, header=header, sep=sep).select(F.col(column).cast(kind).alias(column))


def write_text(df: DataFrame, path: str, pos: str = "pos", value: str = "x") -> None:
    """One number per line, in order over the files by name."""
    df.orderBy(pos).select(F.col(value).cast("string")).write.mode("errorifexists").text(path)


def directory_columns(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """(column, file) of a directory in which each file is a column, by column name."""
    files = spark.read.format("binaryFile").load(path).select("path").collect()
    named = [(os.path.splitext(os.path.basename(r["path"]))[0], r["path"]) for r in files]
    return sorted((binary_name(p)[0] if p.endswith(".bin") else n, p) for n, p in named)


def directory_table(spark: SparkSession, path: str, types: dict[str, str], kind: str = "standalone") -> DataFrame:
    """(pos, one column per file) of equally long files, joined by position."""
    out = None
    for name, file in directory_columns(spark, path):
        if name in types:
            one = scan(spark, file, kind, types[name]).select("pos", F.col("x").alias(name))
            out = one if out is None else out.join(one, "pos")
    if out is None:
        raise InvalidArgumentError(f"none of {sorted(types)} in {path}")
    return out
