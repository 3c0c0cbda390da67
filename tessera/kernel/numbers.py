"""Number types and their order-preserving images in the unsigned integers."""
from dataclasses import dataclass

import numpy as np

from ..errors import InvalidArgumentError


@dataclass(frozen=True)
class NumberType:
    name: str
    code: int
    dtype: np.dtype
    latent: np.dtype
    mantissa: int = 0  # explicit mantissa bits of a float

    @property
    def bits(self) -> int:
        return self.latent.itemsize * 8

    @property
    def middle(self) -> np.unsignedinteger:
        return self.latent.type(1 << (self.bits - 1))

    @property
    def is_float(self) -> bool:
        return self.dtype.kind == "f"


# The type byte of each number type in a file.
CODES = {"u32": 1, "u64": 2, "i32": 3, "i64": 4, "f32": 5, "f64": 6, "u16": 7, "i16": 8, "f16": 9}
MANTISSA = {"f16": 10, "f32": 23, "f64": 52}
TYPES = {name: NumberType(name, code, np.dtype(f"{name[0]}{int(name[1:]) // 8}"), np.dtype(f"u{int(name[1:]) // 8}"), MANTISSA.get(name, 0)) for name, code in CODES.items()}
BY_CODE = {t.code: t for t in TYPES.values()}
BY_DTYPE = {t.dtype: t for t in TYPES.values()}
U32 = TYPES["u32"]


def type_of(x: np.ndarray) -> NumberType:
    if x.dtype not in BY_DTYPE:
        raise InvalidArgumentError(f"no number type for {x.dtype}")
    return BY_DTYPE[x.dtype]


def to_latent(x: np.ndarray, t: NumberType) -> np.ndarray:
    if t.dtype.kind == "u":
        return x.astype(t.latent, copy=False)
    bits = np.ascontiguousarray(x).view(t.latent)
    if t.dtype.kind == "i":
        return bits ^ t.middle
    return np.where(bits >= t.middle, ~bits, bits ^ t.middle)


def from_latent(u: np.ndarray, t: NumberType) -> np.ndarray:
    if t.dtype.kind == "u":
        return u.astype(t.dtype, copy=False)
    if t.dtype.kind == "i":
        return (u ^ t.middle).view(t.dtype)
    return np.where(u >= t.middle, u ^ t.middle, ~u).view(t.dtype)


def int_float_rank(x: np.ndarray, t: NumberType) -> np.ndarray:
    """Rank of an integer-valued float among those: integers up to
    2**(mantissa + 1) one by one, then every float; -0.0 comes just before 0.0."""
    size = np.abs(x)
    limit = t.dtype.type(2.0 ** (t.mantissa + 1))
    small = size < limit
    with np.errstate(invalid="ignore"):
        count = np.where(small, size, 0).astype(t.latent)
    far = size.view(t.latent) - np.asarray(limit).view(t.latent) + t.latent.type(1 << (t.mantissa + 1))
    rank = np.where(small, count, far)
    return np.where(np.signbit(x), t.middle - t.latent.type(1) - rank, t.middle + rank)


def int_float_unrank(u: np.ndarray, t: NumberType) -> np.ndarray:
    neg = u < t.middle
    rank = np.where(neg, t.middle - t.latent.type(1) - u, u - t.middle)
    limit = t.latent.type(1 << (t.mantissa + 1))
    far = rank - limit + np.asarray(t.dtype.type(2.0 ** (t.mantissa + 1))).view(t.latent)
    size = np.where(rank < limit, rank.astype(t.dtype), np.where(rank < limit, t.latent.type(0), far).view(t.dtype))
    return np.where(neg, -size, size)


def bit_length(x: np.ndarray) -> np.ndarray:
    """Bits needed for each unsigned integer, 0 for 0."""
    x = x.astype(np.uint64)
    high = (x >> np.uint64(32)).astype(np.float64)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.int64)


def round_away(x: np.ndarray) -> np.ndarray:
    """Round to integers, halves away from zero."""
    whole = np.trunc(x)
    with np.errstate(invalid="ignore"):
        return np.where(np.abs(x - whole) >= 0.5, whole + np.copysign(np.asarray(1, x.dtype), x), whole)
