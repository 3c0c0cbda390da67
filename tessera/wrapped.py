"""The pieces of the format one by one, for formats that wrap it.

A header, then for each chunk its metadata and its pages, each as bytes of its
own; pages can be written and read in any order."""
import numpy as np

from .errors import CompatibilityError, InsufficientDataError, InvalidArgumentError
from .kernel import chunk as C
from .kernel import numbers as N
from .kernel.bitio import Reader
from .kernel.config import ChunkConfig


class ChunkCompressor:
    """A chunk whose mode, delta and bins are chosen; bytes are made on demand."""

    def __init__(self, x: np.ndarray, config: ChunkConfig | None = None, ntype: N.NumberType | None = None):
        self.plan = C.plan(np.ascontiguousarray(x), ntype or N.type_of(x), config or ChunkConfig())
        self._pages: list[bytes] | None = None

    @property
    def meta(self) -> C.ChunkMeta:
        return self.plan.meta

    def n_per_page(self) -> list[int]:
        return self.plan.page_n

    def meta_size_hint(self) -> int:
        return -(-C.meta_bits(self.plan.meta) // 8)

    def page_size_hint(self, i: int) -> int:
        """About the bytes of a page, 20 per cent over its mean."""
        bits = sum(len(self.plan.stored[v][i]) * b.average_bits() for v, b in self.meta.bins.items())
        return -(-C.page_meta_bits(self.meta) // 8) + int(1.2 * bits / 8) + 1

    def write_meta(self) -> bytes:
        return C.write_meta(self.plan.meta)

    def write_page(self, i: int) -> bytes:
        if not 0 <= i < len(self.plan.page_n):
            raise InvalidArgumentError(f"no page {i}")
        if self._pages is None:
            self._pages = C.write_pages(self.plan)
        return self._pages[i]


class FileCompressor:
    def write_header(self) -> bytes:
        return bytes([C.FORMAT])

    def chunk_compressor(self, x: np.ndarray, config: ChunkConfig | None = None) -> ChunkCompressor:
        return ChunkCompressor(x, config)


class ChunkDecompressor:
    def __init__(self, data: bytes, ntype: N.NumberType, version: int = C.FORMAT):
        r = Reader(data)
        self.meta, self.size = C.read_meta(r, ntype, version), r.byte

    def page(self, data: bytes, n: int) -> np.ndarray:
        return C.read_pages(self.meta, [data], [n])[0][0]

    def pages(self, data: list[bytes], counts: list[int]) -> list[np.ndarray]:
        """Several pages in lockstep."""
        return C.read_pages(self.meta, data, counts)[0]

    def page_into(self, data: bytes, n: int, out: np.ndarray) -> tuple[int, bool]:
        """Fill out from the start of a page: out's length must be a multiple of
        256 or reach the page's end."""
        if len(out) < n and len(out) % 256:
            raise InvalidArgumentError("a part of a page must be whole batches of 256")
        take = min(n, len(out))
        out[:take] = self.page(data, n)[:take]
        return take, take == n


class FileDecompressor:
    def __init__(self, header: bytes):
        if not header:
            raise InsufficientDataError("no header")
        self.version = header[0]
        if self.version > C.FORMAT:
            raise CompatibilityError(f"format version {self.version}")

    def chunk_decompressor(self, data: bytes, ntype: N.NumberType) -> ChunkDecompressor:
        return ChunkDecompressor(data, ntype, self.version)
