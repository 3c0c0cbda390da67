"""Arithmetic of sizes: bins, samples, windows and guarantees."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import bit_length


def bins_log(level: Column | int, n: Column) -> Column:
    """Log of the number of unoptimized bins for a level and a count."""
    level = F.lit(level) if isinstance(level, int) else level
    fast = F.greatest(F.lit(0), bit_length(n) - 5)
    return F.when(level <= fast, level).otherwise(fast + F.floor((level - fast) / 2).cast("int"))


def sample_size(n: Column) -> Column:
    """Numbers to sample; null below 10."""
    return F.when(n >= 10, 10 + F.floor((n - 10) / 40))


def lookback_window_log(n: Column) -> Column:
    return F.least(F.greatest(bit_length(n - 1), F.lit(4)), F.lit(15))


def varint_bits(x: Column) -> Column:
    """Bits of a count in a header: 6 bits of length and the bits themselves."""
    return 6 + F.greatest(bit_length(x), F.lit(1))


def wrapped_guarantee(n: Column, width: int) -> Column:
    """Most bytes of a chunk: one bin's metadata and the numbers verbatim."""
    head = 8 + 19 + width + width.bit_length()
    return F.lit(-(-head // 8)) + n * (width // 8)


def standalone_guarantee(n: Column, width: int) -> Column:
    return wrapped_guarantee(n, width) + 4


def chunk_meta_bits(size_log: Column, n_bins: Column, width: int) -> Column:
    """Exact bits of a classic chunk's metadata with one latent variable."""
    return 8 + 19 + n_bins * (size_log + width + width.bit_length())


def categorical_entropy(p: Column) -> Column:
    return F.when((p == 0) | (p == 1), F.lit(0.0)).otherwise(-p * F.log2(p))


def run_length_applies(n: Column, count: Column) -> Column:
    """Whether a frequent prefix gets run lengths: over 1000 numbers, at least
    0.8 of them but not all."""
    return (n >= 1001) & (count >= 0.8 * n) & (count < n)
