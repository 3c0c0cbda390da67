"""64-bit arithmetic that wraps, and bit counts, inside generated code.

Spark's ANSI mode raises on overflow, so sums and differences go by 32-bit
halves, which can't overflow; shifts and masks wrap by themselves."""
from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = 0xFFFFFFFF
LOWEST = -(1 << 63)


def _halves(lo: Column, hi: Column) -> Column:
    carried = hi + F.shiftright(lo, 32)
    return F.shiftleft(carried, 32).bitwiseOR(lo.bitwiseAND(F.lit(MASK)))


def wrapping_sub(a: Column, b: Column) -> Column:
    m = F.lit(MASK)
    return _halves(a.bitwiseAND(m) - b.bitwiseAND(m), F.shiftright(a, 32) - F.shiftright(b, 32))


def wrapping_add(a: Column, b: Column) -> Column:
    m = F.lit(MASK)
    return _halves(a.bitwiseAND(m) + b.bitwiseAND(m), F.shiftright(a, 32) + F.shiftright(b, 32))


def wrap(total: Column) -> Column:
    """A decimal(38,0) reduced to a wrapped 64-bit integer."""
    mod = F.lit("18446744073709551616").cast("decimal(38,0)")
    half = F.lit("9223372036854775808").cast("decimal(38,0)")
    return (F.pmod(total.cast("decimal(38,0)") + half, mod) - half).cast("long")


def toggle_center(x: Column) -> Column:
    """Ord to latent bits and back: flips the sign bit."""
    return x.bitwiseXOR(F.lit(LOWEST))


def bit_length(x: Column) -> Column:
    """Bits to write an unsigned range (a long read as unsigned): 0 for 0."""
    return F.when(x == 0, F.lit(0)).otherwise(F.length(F.bin(x)))


def lowest_bits(x: Column, n: int) -> Column:
    return x.bitwiseAND(F.lit((1 << n) - 1))


def trailing_zeros(x: Column, width: int = 64) -> Column:
    """Trailing zero bits; width for 0."""
    low = x.bitwiseAND(wrapping_sub(F.lit(0).cast("long"), x))
    return F.when(x == 0, F.lit(width)).otherwise(F.length(F.bin(low)) - 1)
