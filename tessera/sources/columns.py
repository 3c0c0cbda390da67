"""The native table: one row per page, with what is needed to skip or decode it.

Columns: chunk_id, page_id, first_pos, n, min_ord, max_ord, ntype, mode, delta,
meta, payload. A chunk's metadata stands beside each of its pages, where Parquet's
dictionary stores it once, so decoding needs no join; the bounds are ordinary
columns, so a range scan prunes row groups and pages by the usual pushdown."""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidArgumentError
from ..kernel import chunk as C
from ..kernel import numbers as N
from ..kernel.bitio import Reader
from ..kernel.config import ChunkConfig, DeltaSpec, ModeSpec, Paging
from ..operators.layout import CHUNK_N, chunk_of, with_position

#: Pages are decoded in lockstep, so many small ones are faster than few large ones.
PAGE_N = 1024
#: Numbers that one decoding step holds.
STEP_N = 1 << 20
SCHEMA = "chunk_id long, page_id int, first_pos long, n int, min_ord long, max_ord long, ntype string, mode string, delta string, meta binary, payload binary"
ARROW = pa.schema([("chunk_id", pa.int64()), ("page_id", pa.int32()), ("first_pos", pa.int64()), ("n", pa.int32()), ("min_ord", pa.int64()), ("max_ord", pa.int64()), ("ntype", pa.string()), ("mode", pa.string()), ("delta", pa.string()), ("meta", pa.binary()), ("payload", pa.binary())])
SPARK = {"i16": "short", "i32": "int", "i64": "long", "f32": "float", "f64": "double", "u16": "int", "u32": "long", "u64": "decimal(20,0)", "f16": "float"}
BY_SPARK = {T.ShortType: "i16", T.IntegerType: "i32", T.LongType: "i64", T.FloatType: "f32", T.DoubleType: "f64", T.TimestampType: "i64", T.TimestampNTZType: "i64", T.DateType: "i32"}


def config(level: int = 8, mode: str = "auto", delta: str = "auto", page_n: int = PAGE_N) -> ChunkConfig:
    return ChunkConfig(int(level), ModeSpec.parse(mode), DeltaSpec.parse(delta), Paging(int(page_n)))


def ntype_of(df: DataFrame, col: str) -> str:
    kind = type(df.schema[col].dataType)
    if kind not in BY_SPARK:
        raise InvalidArgumentError(f"{df.schema[col].dataType.simpleString()} columns can't be compressed; give an ntype")
    return BY_SPARK[kind]


def plain(df: DataFrame, col: str) -> Column:
    """A column as a number: timestamps as microseconds, dates as days."""
    kind = type(df.schema[col].dataType)
    c = F.col(col)
    if kind in (T.TimestampType, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    return F.unix_date(c) if kind is T.DateType else c


def to_numpy(x: pa.ChunkedArray | pa.Array, t: N.NumberType) -> np.ndarray:
    if pa.types.is_decimal(x.type):
        return np.array([int(v) for v in x.to_pylist()], t.dtype)
    out = x.to_numpy(zero_copy_only=False) if isinstance(x, pa.Array) else x.to_numpy()
    return np.ascontiguousarray(out).astype(t.dtype)


def to_arrow(x: np.ndarray, t: N.NumberType) -> pa.Array:
    if t.name == "u64":
        return pa.array([int(v) for v in x], pa.decimal128(38, 0)).cast(pa.decimal128(20, 0))
    kind = {"u16": np.int32, "u32": np.int64, "f16": np.float32}.get(t.name)
    return pa.array(x if kind is None else x.astype(kind))


def signed_ord(u: np.ndarray, t: N.NumberType) -> np.ndarray:
    return (u ^ t.middle).view(np.dtype(f"i{t.latent.itemsize}")).astype(np.int64)


def compress(df: DataFrame, col: str, *keys: str, options: ChunkConfig | None = None, ntype: str | None = None, chunk_n: int = CHUNK_N, nulls: str = "fail") -> DataFrame:
    """The page table of a column, ordered by keys (unique together).

    Chunks are the groups of the only shuffle; one task holds one chunk, at most
    chunk_n numbers. Nulls raise, or are left out with nulls="drop"."""
    t = N.TYPES[ntype or ntype_of(df, col)]
    opt = options or config()
    if nulls not in ("fail", "drop"):
        raise InvalidArgumentError(f"nulls={nulls!r}")
    df = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], plain(df, col).alias("x"))
    if nulls == "drop":
        df = df.where(F.col("x").isNotNull())
    seq = with_position(df, *[f"k{i}" for i in range(len(keys))]).select("pos", "x").withColumn("chunk_id", chunk_of(F.col("pos"), chunk_n))
    name = t.name

    def run(group: pa.Table) -> pa.Table:
        return _chunk_rows(group.sort_by("pos"), N.TYPES[name], opt)

    return seq.groupBy("chunk_id").applyInArrow(run, SCHEMA)


def _chunk_rows(group: pa.Table, t: N.NumberType, opt: ChunkConfig) -> pa.Table:
    if group.column("x").null_count:
        raise InvalidArgumentError("a null in the column; drop nulls or keep their places in a column of their own")
    x = to_numpy(group.column("x"), t)
    meta, pages, plan = C.compress(x, t, opt)
    ends = np.cumsum(plan.page_n)
    starts = ends - plan.page_n
    o = signed_ord(N.to_latent(x, t), t)
    k, first = len(pages), group.column("pos")[0].as_py()
    mode, delta = plan.meta.mode, plan.meta.delta
    told = mode.kind + {"int_mult": f"@{mode.base}", "float_mult": f"@{mode.base}", "float_quant": f"@{mode.k}"}.get(mode.kind, "")
    back = delta.kind + (f"@{delta.order}" if delta.kind == "consecutive" else "")
    rows = [[group.column("chunk_id")[0].as_py()] * k, list(range(k)), (first + starts).tolist(), plan.page_n, np.minimum.reduceat(o, starts).tolist(), np.maximum.reduceat(o, starts).tolist(), [t.name] * k, [told] * k, [back] * k, [meta] * k, pages]
    return pa.table([pa.array(r, f.type) for r, f in zip(rows, ARROW, strict=True)], schema=ARROW)


def decompress(pages: DataFrame, ntype: str, lo: int | None = None, hi: int | None = None, also: str | None = None) -> DataFrame:
    """(pos, x) of a page table; with bounds, only numbers whose ord is in
    [lo, hi): pages outside are pruned before they are decoded. ``also`` names a
    column of longs that comes along; chunks are told apart by it too."""
    t = N.TYPES[ntype]
    if lo is not None:
        pages = pages.where(F.col("max_ord") >= lo)
    if hi is not None:
        pages = pages.where(F.col("min_ord") < hi)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = N.TYPES[ntype]
        for batch in batches:
            names = [batch.column(c).to_pylist() for c in ("chunk_id", *extra)]
            for rows in _steps(list(zip(*names, strict=True)), batch.column("n").to_pylist()):
                part = _decoded(batch.take(pa.array(rows)), t, lo, hi)
                more = [pa.array(np.full(part.num_rows, names[-1][rows[0]], np.int64))] if extra else []
                yield pa.RecordBatch.from_arrays([*part.columns, *more], ["pos", "x", *extra])

    extra = [also] if also else []
    return pages.select("chunk_id", "first_pos", "n", "meta", "payload", *extra).mapInArrow(run, f"pos long, x {SPARK[t.name]}" + "".join(f", {c} long" for c in extra))


def _steps(chunks: list[tuple], counts: list[int]) -> Iterator[list[int]]:
    """Row numbers of pages of one chunk at a time, at most about STEP_N numbers."""
    by_chunk: dict[tuple, list[int]] = {}
    for i, c in enumerate(chunks):
        by_chunk.setdefault(c, []).append(i)
    for rows in by_chunk.values():
        held, n = [], 0
        for i in rows:
            held.append(i)
            n += counts[i]
            if n >= STEP_N:
                yield held
                held, n = [], 0
        if held:
            yield held


def _decoded(rows: pa.RecordBatch, t: N.NumberType, lo: int | None, hi: int | None) -> pa.RecordBatch:
    counts = rows.column("n").to_pylist()
    meta = C.read_meta(Reader(rows.column("meta")[0].as_py()), t)
    parts, _ = C.read_pages(meta, rows.column("payload").to_pylist(), counts)
    x = np.concatenate(parts)
    pos = np.concatenate([np.arange(a, a + n) for a, n in zip(rows.column("first_pos").to_pylist(), counts, strict=True)])
    if lo is not None or hi is not None:
        o = signed_ord(N.to_latent(x, t), t)
        keep = np.ones(len(o), bool)
        if lo is not None:
            keep &= o >= lo
        if hi is not None:
            keep &= o < hi
        x, pos = x[keep], pos[keep]
    return pa.RecordBatch.from_arrays([pa.array(pos), to_arrow(x, t)], ["pos", "x"])


def write(df: DataFrame, path: str, col: str, *keys: str, **how) -> None:
    """Write a column's page table as Parquet, sorted by chunk so that row groups
    have narrow bounds."""
    compress(df, col, *keys, **how).sortWithinPartitions("chunk_id", "page_id").write.mode("errorifexists").parquet(path)


def chunk_info(pages: DataFrame) -> DataFrame:
    """What each chunk chose and how large it is, without reading a payload's numbers."""
    return pages.groupBy("chunk_id").agg(F.first("ntype").alias("ntype"), F.first("mode").alias("mode"), F.first("delta").alias("delta"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_pages"), F.max(F.octet_length("meta")).alias("meta_bytes"), F.sum(F.octet_length("payload")).alias("page_bytes"), F.min("min_ord").alias("min_ord"), F.max("max_ord").alias("max_ord"))


def bin_rows(pages: DataFrame) -> DataFrame:
    """The bins of every chunk from its metadata: (chunk_id, latent_var, symbol,
    weight, size_log, lower, offset_bits); lower as text, it may be unsigned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["chunk_id", "latent_var", "symbol", "weight", "size_log", "lower", "offset_bits"]
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32()]
        for batch in batches:
            out = []
            for c, name, meta in zip(*(batch.column(k).to_pylist() for k in ("chunk_id", "ntype", "meta")), strict=True):
                got = C.read_meta(Reader(meta), N.TYPES[name])
                out += [(c, v, i, int(b.weight[i]), b.size_log, str(b.lower[i]), int(b.offset_bits[i])) for v, b in got.bins.items() for i in range(len(b))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    one = pages.where("page_id = 0").select("chunk_id", "ntype", "meta")
    return one.mapInArrow(run, "chunk_id long, latent_var string, symbol int, weight int, size_log int, lower string, offset_bits int")
