"""Sums of fixed-size arrays over the tasks of a job.

Each task emits its array in blocks, a block with few entries as their places
and values; blocks are dealt by number and summed on the executors, so that only
one array of the fixed size reaches the driver."""
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "block int, part binary"
_DENSE, _SPARSE = b"\0\0\0\0\0\0\0\0", b"\1\0\0\0\0\0\0\0"


def blocks_of(array: np.ndarray, size: int) -> pa.RecordBatch:
    """The blocks of array (uint16) that aren't all zero; size is at most 2**16."""
    numbers, parts = [], []
    for i, at in enumerate(range(0, len(array), size)):
        block = array[at : at + size]
        some = np.flatnonzero(block)
        if len(some):
            numbers.append(i)
            parts.append(_DENSE + block.tobytes() if 2 * len(some) > size else _SPARSE + some.astype(np.uint16).tobytes() + block[some].tobytes())
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(parts, pa.binary())], ["block", "part"])


def _add(sums: np.ndarray, part: bytes) -> None:
    x = np.frombuffer(part, np.uint16, offset=8)
    if part[:8] == _DENSE:
        sums[: len(x)] += x
    else:
        half = len(x) // 2
        sums[x[:half]] += x[half:]


def total(parts: DataFrame, length: int, size: int, finish: Callable[[np.ndarray], np.ndarray] = lambda x: x, kind: type = np.int64) -> np.ndarray:
    """The sum of what the tasks emitted; ``finish`` turns sums (int64) into values
    of ``kind`` on the executors. Finished zeros must be zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("part"), strict=True):
                if block not in sums:
                    sums[block] = np.zeros(size, np.int64)
                _add(sums[block], part.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([finish(v).astype(kind).tobytes() for v in sums.values()], pa.binary())], ["block", "part"])

    out = np.zeros(length, kind)
    n = min(-(-length // size), int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    for r in parts.repartition(n, "block").mapInArrow(run, SCHEMA).collect():
        x = np.frombuffer(r["part"], kind)
        out[r["block"] * size :][: len(x)] = x[: length - r["block"] * size]
    return out
