"""Files of one sequence: header, chunks of one page each, footer."""
import numpy as np

from .errors import CompatibilityError, CorruptionError, InsufficientDataError
from .kernel import chunk as C
from .kernel import numbers as N
from .kernel.bitio import Reader, Writer
from .kernel.config import ChunkConfig

# The first bytes of a file and the versions written.
MAGIC = bytes.fromhex("70636f21")
VERSION, END = 2, 0


def header(n_hint: int = 0) -> bytes:
    w = Writer()
    power = max(1, int(n_hint).bit_length())
    w.bits(power - 1, 6)
    w.bits(n_hint, power)
    return MAGIC + bytes([VERSION]) + w.bytes() + bytes([C.FORMAT])


def write_chunk(x: np.ndarray, config: ChunkConfig | None = None, ntype: N.NumberType | None = None) -> bytes:
    """One chunk of one page, with type and count."""
    t, config = ntype or N.type_of(x), config or ChunkConfig()
    one = ChunkConfig(config.level, config.mode, config.delta, type(config.paging)(max(1, len(x))))
    meta, pages, _ = C.compress(x, t, one)
    return bytes([t.code]) + (len(x) - 1).to_bytes(3, "little") + meta + pages[0]


FOOTER = bytes([END])


def compress(x: np.ndarray, config: ChunkConfig | None = None) -> bytes:
    """A whole file; the paging of config decides the chunks."""
    x, config = np.ascontiguousarray(x), config or ChunkConfig()
    N.type_of(x)
    out, at = [header(len(x))], 0
    for n in config.paging.counts(len(x)) if len(x) else []:
        out.append(write_chunk(x[at : at + n], config))
        at += n
    return b"".join([*out, FOOTER])


class FileReader:
    """Chunks of a file, one after another."""

    def __init__(self, data: bytes):
        self.data = data
        if len(data) < 4:
            raise InsufficientDataError("no header")
        if data[:4] != MAGIC:
            raise CorruptionError("not a file of this format")
        r = Reader(data, 4)
        self.version = r.bits(8)
        if self.version > VERSION:
            raise CompatibilityError(f"file version {self.version}")
        self.n_hint = r.bits(1 + r.bits(6)) if self.version >= 2 else 0
        r.align()
        self.format = r.bits(8)
        if self.format > C.FORMAT:
            raise CompatibilityError(f"format version {self.format}")
        self.at = r.byte

    def peek(self) -> N.NumberType | None:
        """The next chunk's type; None at the end of the file."""
        if self.at >= len(self.data):
            raise InsufficientDataError("no footer")
        code = self.data[self.at]
        if code == END:
            return None
        if code not in N.BY_CODE:
            raise CorruptionError(f"unknown number type {code}")
        return N.BY_CODE[code]

    def chunks(self, ntype: N.NumberType | None = None):
        """(numbers, meta, meta bytes, page bytes) of each chunk."""
        while (t := self.peek()) is not None:
            if ntype is not None and t != ntype:
                raise CorruptionError(f"expected {ntype.name}, found {t.name}")
            r = Reader(self.data, self.at + 1)
            n = r.bits(24) + 1
            begin = r.byte
            meta = C.read_meta(r, t, self.format)
            middle = r.byte
            (x,), self.at = C.read_pages(meta, [self.data], [n], whole=False, at=middle)
            yield x, meta, middle - begin, self.at - middle


def decompress(data: bytes, ntype: N.NumberType | None = None) -> np.ndarray | None:
    """All numbers of a file; None if it has no chunk and no type is given."""
    parts = [x for x, *_ in FileReader(data).chunks(ntype)]
    if parts:
        return np.concatenate(parts)
    return None if ntype is None else np.zeros(0, ntype.dtype)


def decompress_into(data: bytes, out: np.ndarray) -> tuple[int, bool]:
    """Fill out from the start of a file: (numbers written, whether that was all)."""
    n = 0
    for x, *_ in FileReader(data).chunks(N.type_of(out)):
        take = min(len(x), len(out) - n)
        out[n : n + take] = x[:take]
        n += take
        if take < len(x):
            return n, False
    return n, True


def file_guarantee(ntype: N.NumberType, counts: list[int]) -> int:
    """Bytes that a file of chunks with these counts never exceeds."""
    return len(header(sum(counts))) + sum(4 + C.guarantee(ntype, n) for n in counts) + 1
