"""Order-preserving integers ("ords") of numbers, and how numbers split.

The ord of a number is its latent with the sign bit flipped, read as a signed
long: it sorts as the number does and differences of ords are the codec's
deltas."""
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import trailing_zeros, wrapping_add, wrapping_sub

U64 = "decimal(20,0)"
TOP = 0x7FFFFFFFFFFFFFFF
#: 2**63, the latent of the integer 0.
CENTER = "9223372036854775808"


def _viewed(source: pa.DataType, target: pa.DataType, kind: str) -> Callable[[Column], Column]:
    """A reinterpretation of bits, a batch at a time; nulls stay null."""

    def make(c: Column) -> Column:
        @F.arrow_udf(kind)
        def run(x: pa.Array) -> pa.Array:
            return x.cast(source).view(target)

        return run(c)

    return make


f64_bits = _viewed(pa.float64(), pa.int64(), "bigint")
bits_f64 = _viewed(pa.int64(), pa.float64(), "double")
f32_bits = _viewed(pa.float32(), pa.int32(), "int")
bits_f32 = _viewed(pa.int32(), pa.float32(), "float")


def int_to_ord(x: Column) -> Column:
    return x.cast("long")


def _flip(bits: Column, top: int) -> Column:
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit(top)))


def f64_to_ord(x: Column) -> Column:
    return _flip(f64_bits(x), TOP)


def f32_to_ord(x: Column) -> Column:
    return _flip(f32_bits(x), 0x7FFFFFFF).cast("long")


def ord_to_f64(o: Column) -> Column:
    return bits_f64(_flip(o, TOP))


def to_latent(o: Column) -> Column:
    """The unsigned latent of an ord, as decimal(20,0)."""
    return (o.cast("decimal(38,0)") + F.lit(CENTER).cast("decimal(38,0)")).cast(U64)


def from_latent(u: Column) -> Column:
    return (u.cast("decimal(38,0)") - F.lit(CENTER).cast("decimal(38,0)")).cast("long")


def int_mult_split(o: Column, base: int) -> tuple[Column, Column]:
    """(multiplier, adjustment) of the latent, exact for every base."""
    u, b = to_latent(o).cast("decimal(38,0)"), F.lit(str(base)).cast(U64)
    rest = u % b
    return ((u - rest) / b).cast(U64), rest.cast(U64)


def int_mult_join(mult: Column, adj: Column, base: int) -> Column:
    return from_latent(mult.cast(U64) * F.lit(str(base)).cast(U64) + adj.cast(U64))


def float_mult_split(x: Column, base: float) -> tuple[Column, Column]:
    """(integer multiple, adjustment in ULPs) of a double: multiples round half
    away from zero."""
    mult = F.round(x * F.lit(1.0 / base))
    return mult, wrapping_sub(f64_to_ord(x), f64_to_ord(mult * F.lit(base)))


def float_mult_join(mult: Column, adj: Column, base: float) -> Column:
    return ord_to_f64(wrapping_add(f64_to_ord(mult * F.lit(base)), adj))


def float_quant_split(o: Column, k: int) -> tuple[Column, Column]:
    """(quantum, remainder) of an ord: the remainder counts away from zero."""
    low = o.bitwiseAND(F.lit((1 << k) - 1))
    return F.shiftright(o, k), F.when(o >= 0, low).otherwise(F.lit((1 << k) - 1) - low)


def float_quant_join(quantum: Column, rest: Column, k: int) -> Column:
    low = F.when(quantum >= 0, rest).otherwise(F.lit((1 << k) - 1) - rest)
    return F.shiftleft(quantum, k).bitwiseOR(low)


def int_float_rank(x: Column) -> Column:
    """Rank of an integer-valued double, 0.0 at 0 and -0.0 at -1."""
    bits = f64_bits(x)
    size = bits.bitwiseAND(F.lit(TOP))
    limit = 1 << 53
    rank = F.when(F.abs(x) < float(limit), F.abs(x).cast("long")).otherwise(size - F.lit(int(np.float64(limit).view(np.int64))) + F.lit(limit))
    return F.when(bits >= 0, rank).otherwise(-rank - 1)


def float_exponent(x: Column) -> Column:
    """Unbiased binary exponent of a double."""
    return F.shiftright(f64_bits(x), 52).bitwiseAND(F.lit(0x7FF)).cast("int") - 1023


def float_trailing_zeros(x: Column) -> Column:
    """Trailing zeros of the mantissa bits of a double."""
    return F.least(trailing_zeros(f64_bits(x)), F.lit(52))


def pair_gcd(a: Column, b: Column) -> Column:
    """Greatest common divisor of two non-negative longs."""

    @F.arrow_udf("bigint")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        none = np.asarray(x.is_null()) | np.asarray(y.is_null())
        out = np.gcd(np.asarray(x.fill_null(0), np.int64), np.asarray(y.fill_null(0), np.int64))
        return pa.array(out, mask=none)

    return run(a, b)


def triple_gcd(a: Column, b: Column, c: Column) -> Column:
    """gcd of the differences of three longs to the smallest."""
    low = F.least(a, b, c)
    return pair_gcd(pair_gcd(a - low, b - low), c - low)


def snap_base(base: Column) -> Column:
    """The reciprocal of an integer or of a power of ten near base, else base."""
    inv = F.lit(1.0) / base
    whole = F.round(inv)
    ten = F.pow(F.lit(10.0), F.round(F.log10(inv)))
    return F.when(F.abs(inv - whole) < 0.02, 1.0 / whole).when(F.abs(inv - ten) / inv < 0.01, 1.0 / ten).otherwise(base)


def float_sample(x: Column) -> Column:
    """Whether a double may be in the sample that modes are chosen on."""
    size = F.abs(x)
    return ~F.isnan(x) & (size >= float(np.finfo(np.float64).tiny)) & (size <= float(np.finfo(np.float64).max / 2))


def timestamp_micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def timestamp_parts(micros: Column) -> tuple[Column, Column]:
    """(seconds, microseconds in [0, 1e6)) by euclidean division."""
    part = F.pmod(micros, F.lit(1_000_000))
    return ((micros - part) / 1_000_000).cast("long"), part


def describe_latent(primary: Column, kind: str, unit: str = "") -> Column:
    """Human text of a latent's ord: the value, or a signed delta with a unit."""
    if kind == "classic":
        return primary.cast("string")
    return F.concat(F.when(primary >= 0, F.lit("+")).otherwise(F.lit("")), primary.cast("string"), F.lit(unit))
