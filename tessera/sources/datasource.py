"""``spark.read.format("tessera")`` and ``df.write.format("tessera")``.

A data source over standalone files on a path that executors have mounted (for
other stores use ``files.scan``). Options: ntype, level, mode, delta, chunkN, and
raw=true to write plain little-endian numbers instead.
Columns: pos (when read, in its file; ``files.in_order`` numbers over files) and x.
A writer's task makes one file of its rows in their order, under a hidden name that
it removes if it fails. The driver commits by renaming; the names sort by write,
then by task, so appended rows come last. Overwriting removes what was there only
after the new files have their names."""
import glob
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .. import standalone
from ..errors import CodecIOError, InvalidArgumentError
from ..kernel import numbers as N
from .columns import SPARK, config, to_arrow, to_numpy
from .files import BATCH_N

EXTENSION = ".tcol"
#: Bytes that surely hold a header and one more.
HEAD = 64


def local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


@dataclass
class FilePart(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    files: list


class ColumnSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessera"

    def _ntype(self) -> str:
        if "ntype" in self.options:
            return self.options["ntype"].lower()
        for path in _files(self.options["path"]):
            # A file's header and the type of its first chunk are its first bytes.
            with open(path, "rb") as f:
                t = standalone.FileReader(f.read(HEAD)).peek()
            if t is not None:
                return t.name
        raise InvalidArgumentError("no chunk to tell the number type; give ntype")

    def schema(self) -> str:
        return f"pos long, x {SPARK[self._ntype()]}"

    def reader(self, schema) -> "ColumnReader":
        return ColumnReader(self.options["path"], self._ntype())

    def writer(self, schema, overwrite: bool) -> "ColumnWriter":
        kinds = {"short": "i16", "smallint": "i16", "int": "i32", "bigint": "i64", "float": "f32", "double": "f64"}
        ntype = self.options.get("ntype") or kinds.get(schema["x"].dataType.simpleString())
        if not ntype:
            raise InvalidArgumentError("give an ntype for this column")
        o = self.options
        conf = config(o.get("level", 8), o.get("mode", "auto"), o.get("delta", "auto"), int(o.get("chunkn", 1 << 18)))
        return ColumnWriter(local(o["path"]), ntype.lower(), conf, overwrite, str(o.get("raw", "")).lower() == "true")


def _files(path: str, extension: str = EXTENSION) -> list[str]:
    path = local(path)
    return sorted(glob.glob(os.path.join(path, f"*{extension}"))) if os.path.isdir(path) else sorted(glob.glob(path))


class ColumnReader(DataSourceReader):
    def __init__(self, path: str, ntype: str):
        self.path, self.ntype = path, ntype

    def partitions(self) -> list[FilePart]:
        return [FilePart(p) for p in _files(self.path)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        t = N.TYPES[self.ntype]
        with open(partition.path, "rb") as f:
            data = f.read()
        at = 0
        for x, *_ in standalone.FileReader(data).chunks(t):
            for i in range(0, len(x), BATCH_N):
                part = x[i : i + BATCH_N]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), to_arrow(part, t)], ["pos", "x"])
                at += len(part)


class ColumnWriter(DataSourceArrowWriter):
    def __init__(self, path: str, ntype: str, conf, overwrite: bool, raw: bool = False):
        self.path, self.ntype, self.conf, self.overwrite, self.raw = path, ntype, conf, overwrite, raw
        self.extension = ".bin" if raw else EXTENSION
        if "://" in path:
            raise CodecIOError(f"{path} isn't a mounted path")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        t = N.TYPES[self.ntype]
        chunk_n = self.conf.paging.most
        held: list[np.ndarray] = []
        os.makedirs(self.path, exist_ok=True)
        made = os.path.join(self.path, f".{uuid.uuid4().hex}{self.extension}")
        try:
            self._write(made, batches, t, chunk_n, held)
        except BaseException:
            if os.path.exists(made):
                os.remove(made)
            raise
        return Written([made])

    def _write(self, made: str, batches: Iterator[pa.RecordBatch], t: N.NumberType, chunk_n: int, held: list[np.ndarray]) -> None:
        n = 0
        with open(made, "wb") as f:
            if not self.raw:
                f.write(standalone.header())
            for batch in batches:
                column = batch.column("x")
                if column.null_count:
                    raise InvalidArgumentError("a null in the column")
                x = to_numpy(column, t)
                if self.raw:
                    f.write(x.astype(t.dtype.newbyteorder("<")).tobytes())
                    continue
                held.append(x)
                n += len(x)
                while n >= chunk_n:
                    x = np.concatenate(held)
                    f.write(standalone.write_chunk(x[:chunk_n], self.conf, t))
                    held, n = [x[chunk_n:]], n - chunk_n
            if n:
                f.write(standalone.write_chunk(np.concatenate(held), self.conf, t))
            if not self.raw:
                f.write(standalone.FOOTER)

    def commit(self, messages: list) -> None:
        there = _files(self.path, self.extension)
        writes = [int(m[1]) for p in there if (m := re.match(r"part-(\d+)-", os.path.basename(p)))]
        write = max(writes, default=-1) + 1
        for i, made in enumerate(p for m in messages if m for p in m.files):
            os.rename(made, os.path.join(self.path, f"part-{write:05d}-{i:05d}{self.extension}"))
        for old in there if self.overwrite else ():
            os.remove(old)

    def abort(self, messages: list) -> None:
        for made in (p for m in messages if m for p in m.files):
            if os.path.exists(made):
                os.remove(made)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ColumnSource)
