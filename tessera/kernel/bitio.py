"""Little-endian bit strings, written and read in bulk."""
import numpy as np

from ..errors import CorruptionError, InsufficientDataError

_ONE = np.uint64(1)


def pack(values: np.ndarray, lengths: np.ndarray, at: np.ndarray | None = None, n_bits: int | None = None) -> np.ndarray:
    """Bytes with values[i] in lengths[i] bits (0 to 64), one after another or
    at the ascending bit positions ``at``. Bits above a length must be 0."""
    some = lengths > 0
    if at is None:
        at = np.cumsum(lengths) - lengths
    total = int(n_bits if n_bits is not None else lengths.sum())
    words = np.zeros(total // 64 + 2, np.uint64)
    v, p = values[some], at[some].astype(np.int64)
    if len(v):
        word, shift = p >> 6, (p & 63).astype(np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] |= np.bitwise_or.reduceat(v << shift, first)
        words[word[first] + 1] |= np.bitwise_or.reduceat((v >> _ONE) >> (np.uint64(63) - shift), first)
    return words.view(np.uint8)[: -(-total // 8)]


class Windows:
    """Random access to bit strings of up to 64 bits."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        self.n_bits = len(data) * 8
        self.words = np.lib.stride_tricks.as_strided(padded, (len(padded) - 8, 8), (1, 1)).copy().view("<u8")[:, 0]
        self.ninth = padded[8:]

    def read(self, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        byte = np.minimum(at >> 3, len(self.words) - 1)
        shift = (at & 7).astype(np.uint64)
        out = self.words[byte] >> shift
        if lengths.size and lengths.max() > 57:
            out |= (self.ninth[byte].astype(np.uint64) << (np.uint64(63) - shift)) << _ONE
        mask = (_ONE << (lengths & 63).astype(np.uint64)) - _ONE
        return out & np.where(lengths == 64, ~np.uint64(0), mask)


class Reader:
    """Sequential reads of small fields."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.bit = data, at * 8

    def bits(self, n: int) -> int:
        end = self.bit + n
        if end > len(self.data) * 8:
            raise InsufficientDataError(f"needed {n} bits at bit {self.bit}")
        lo = self.bit >> 3
        out = int.from_bytes(self.data[lo : -(-end // 8)], "little") >> (self.bit & 7)
        self.bit = end
        return out & ((1 << n) - 1)

    def align(self) -> None:
        rest = -self.bit % 8
        if rest and self.bits(rest):
            raise CorruptionError("padding bits are not zero")

    @property
    def byte(self) -> int:
        return self.bit >> 3


class Writer:
    def __init__(self):
        self.value, self.n = 0, 0

    def bits(self, value: int, n: int) -> None:
        self.value |= int(value) << self.n
        self.n += n

    def align(self) -> None:
        self.n += -self.n % 8

    def bytes(self) -> bytes:
        self.align()
        return self.value.to_bytes(self.n // 8, "little")
