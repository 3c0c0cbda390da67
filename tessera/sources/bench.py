"""Codecs side by side: every chunk is compressed, decompressed and compared."""
import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import standalone
from ..kernel import numbers as N
from ..operators.layout import CHUNK_N, chunk_of, with_position
from .columns import to_numpy


def _arrow(name: str, level: int | None = None) -> tuple[Callable, Callable]:
    codec = pa.Codec(name, compression_level=level) if level is not None else pa.Codec(name)
    return (lambda x: codec.compress(x.tobytes(), asbytes=True)), (lambda b, x: np.frombuffer(codec.decompress(b, x.nbytes, asbytes=True), x.dtype))


def _parquet() -> tuple[Callable, Callable]:
    import io

    import pyarrow.parquet as pq

    def pack(x: np.ndarray) -> bytes:
        out = io.BytesIO()
        pq.write_table(pa.table({"x": pa.array(x)}), out, compression="zstd", compression_level=1)
        return out.getvalue()

    return pack, lambda b, x: pq.read_table(io.BytesIO(b)).column("x").to_numpy()


def _shuffled() -> tuple[Callable, Callable]:
    """Bytes of equal significance side by side, then zstd."""
    codec = pa.Codec("zstd", compression_level=3)
    return (lambda x: codec.compress(x.view(np.uint8).reshape(len(x), -1).T.tobytes(), asbytes=True)), (
        lambda b, x: np.ascontiguousarray(np.frombuffer(codec.decompress(b, x.nbytes, asbytes=True), np.uint8).reshape(x.dtype.itemsize, -1).T).view(x.dtype)[:, 0]
    )


#: name -> function that makes (compress, decompress).
CODECS: dict[str, Callable[[], tuple[Callable, Callable]]] = {
    "tessera": lambda: (standalone.compress, lambda b, x: standalone.decompress(b)),
    "parquet": _parquet,
    "zstd": lambda: _arrow("zstd", 3),
    "snappy": lambda: _arrow("snappy"),
    "brotli": lambda: _arrow("brotli", 1),
    "shuffle_zstd": _shuffled,
}


def measure(x: np.ndarray, codec: str, iters: int = 10) -> list[tuple[float, float, int]]:
    """(compress s, decompress s, bytes) of each run, after a run that checks the bits."""
    pack, unpack = CODECS[codec]()
    t = N.type_of(x)
    if N.to_latent(np.ascontiguousarray(unpack(pack(x), x)), t).tobytes() != N.to_latent(x, t).tobytes():
        raise AssertionError(f"{codec} is not lossless")
    out = []
    for _ in range(iters):
        a = time.perf_counter()
        data = pack(x)
        b = time.perf_counter()
        unpack(data, x)
        out.append((b - a, time.perf_counter() - b, len(data)))
    return out


def run_codecs(df: DataFrame, cols: dict[str, str], key: str, codecs: list[str], chunk_n: int = CHUNK_N, iters: int = 10) -> DataFrame:
    """(input, codec, iter, chunk_id, compress_dt, decompress_dt, compressed_size):
    chunks of the columns, dealt over tasks. Run it with one core for honest times."""
    seq = with_position(df.select(key, *cols), key).withColumn("chunk_id", chunk_of(F.col("pos"), chunk_n))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        rows = []
        for col, ntype in cols.items():
            x = to_numpy(group.column(col), N.TYPES[ntype])
            for codec in codecs:
                rows += [(col, codec, i, group.column("chunk_id")[0].as_py(), *m) for i, m in enumerate(measure(x, codec, iters))]
        names = ["input", "codec", "iter", "chunk_id", "compress_dt", "decompress_dt", "compressed_size"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return seq.groupBy("chunk_id").applyInArrow(run, "input string, codec string, iter int, chunk_id long, compress_dt double, decompress_dt double, compressed_size long")
