"""Decoding standalone files from blobs as they arrive."""
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import standalone
from ..errors import CorruptionError, InsufficientDataError
from ..sources.columns import SPARK, to_arrow
from ..kernel import chunk as C
from ..kernel import numbers as N
from ..kernel.bitio import Reader


class PushDecoder:
    """Takes bytes in any portions and gives what they complete.

    Nothing is consumed until an item is whole: if the bytes don't suffice the
    state stays as it was. Items: ("header", format version), ("chunk", meta),
    ("numbers", array), ("footer", None)."""

    def __init__(self, limit: int = 100_000, buffer: bytes = b"", begun: bool = False, done: bool = False):
        self.limit, self.buffer, self.begun, self.done = limit, buffer, begun, done

    def feed(self, data: bytes) -> Iterator[tuple]:
        self.buffer += data
        while (items := self._next()) is not None:
            yield from items

    def _next(self) -> list[tuple] | None:
        if self.done:
            if self.buffer:
                raise CorruptionError("bytes after the footer")
            return None
        try:
            if not self.begun:
                reader = standalone.FileReader(self.buffer)
                self.buffer, self.begun = self.buffer[reader.at :], True
                return [("header", reader.format)]
            if not self.buffer:
                return None
            if self.buffer[0] == standalone.END:
                self.buffer, self.done = self.buffer[1:], True
                return [("footer", None)]
            if self.buffer[0] not in N.BY_CODE:
                raise CorruptionError(f"unknown number type {self.buffer[0]}")
            r = Reader(self.buffer, 1)
            n = r.bits(24) + 1
            meta = C.read_meta(r, N.BY_CODE[self.buffer[0]])
            (x,), end = C.read_pages(meta, [self.buffer], [n], whole=False, at=r.byte)
        except InsufficientDataError:
            return None
        self.buffer = self.buffer[end:]
        return [("chunk", meta), *(("numbers", x[i : i + self.limit]) for i in range(0, n, self.limit))]


def decode_stream(blobs: DataFrame, ntype: str = "f64") -> DataFrame:
    """(stream_id, pos, x) from a stream of (stream_id, seq, blob), the bytes of
    one file per stream_id in the order of seq; x has the files' number type, and
    a chunk of another type raises. The state of a stream is its undecoded bytes,
    at most one chunk."""
    t = N.TYPES[ntype]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, begun, done, pos = state.get if state.exists else (b"", False, False, 0)
        decoder, out = PushDecoder(buffer=rest, begun=begun, done=done), []
        for blob in pd.concat(frames).sort_values("seq")["blob"]:
            for kind, x in decoder.feed(bytes(blob)):
                if kind == "chunk" and x.ntype != t:
                    raise CorruptionError(f"expected {t.name}, found {x.ntype.name}")
                if kind == "numbers":
                    out.append(x)
        x = np.concatenate(out) if out else np.zeros(0, t.dtype)
        state.update((decoder.buffer, decoder.begun, decoder.done, pos + len(x)))
        # Exact in every type: unsigned 64-bit numbers are decimals.
        yield pd.DataFrame({"stream_id": [key[0]] * len(x), "pos": np.arange(pos, pos + len(x)), "x": to_arrow(x, t).to_pandas()})

    return blobs.groupBy("stream_id").applyInPandasWithState(run, f"stream_id string, pos long, x {SPARK[t.name]}", "rest binary, begun boolean, done boolean, pos long", "append", GroupStateTimeout.NoTimeout)
