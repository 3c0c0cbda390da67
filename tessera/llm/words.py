"""Hashes of the words of many texts at once.

A word is a run of bytes without ASCII white space, with A-Z in lower case. Its
hash is a polynomial over random values of its bytes, modulo 2**64 with an odd
base: sums of all bytes up to each place give every word's hash by one
difference, so no word is built as a Python object."""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes hashed at once; a longer word is hashed by itself.
BLOCK = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _values() -> np.ndarray:
    out = np.random.default_rng(5).integers(0, 1 << 64, 256, dtype=np.uint64)
    out[65:91] = out[97:123]
    out[_SPACE] = 0
    return out


_VALUE = _values()
_POWER: list[np.ndarray] = []


def _powers() -> list[np.ndarray]:
    """[powers of the base, powers of its inverse], made when first used."""
    if not _POWER:
        for base in (int(_ODD), pow(int(_ODD), -1, 1 << 64)):
            p = np.full(BLOCK + 1, base, np.uint64)
            p[0] = 1
            _POWER.append(np.cumprod(p, dtype=np.uint64))
    return _POWER


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word, in order. Words end at offsets."""
    full = ~_SPACE[data]
    begins, ends = np.empty(len(data) + 1, bool), np.empty(len(data) + 1, bool)
    begins[0], ends[0] = len(data) > 0 and full[0], False
    begins[1:-1] = full[1:] & ~full[:-1]
    ends[1:-1] = full[:-1] & ~full[1:]
    begins[-1], ends[-1] = False, len(data) > 0 and full[-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    cuts = cuts[full[cuts] & full[cuts - 1]]
    begins[cuts] = ends[cuts] = True
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    out = np.empty(len(first), np.uint64)
    power, back = _powers()
    i = 0
    while i < len(first):
        at = int(first[i])
        j = int(np.searchsorted(last, at + BLOCK, "right"))
        if j == i:  # a word of more than a block
            out[i] = xxhash.xxh3_64_intdigest(data[at : last[i]].tobytes().lower())
            i += 1
            continue
        part = _VALUE[data[at : last[j - 1]]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * power[: len(part)], dtype=np.uint64, out=sums[1:])
        b, e = first[i:j] - at, last[i:j] - at
        out[i:j] = (sums[e] - sums[b]) * back[b] + (e - b).astype(np.uint64)
        i = j
    return mix(out), first


def counted(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, words of each text)."""
    data, offsets = raw(texts)
    h, first = hashes(data, offsets)
    return h, np.diff(np.searchsorted(first, offsets))


def parts(texts: pa.Array, most: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) in parts of about ``most`` bytes."""
    _, offsets = raw(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, texts[at:end]
        at = end
