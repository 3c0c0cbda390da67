"""Splitting numbers into latents and joining them again."""
import numpy as np

from ..errors import InvalidArgumentError
from . import numbers as N
from .config import Mode


def check(mode: Mode, t: N.NumberType) -> None:
    """Raise unless mode can be used with the type."""
    if mode.kind == "classic":
        return
    if mode.kind == "int_mult":
        if t.is_float or not 1 <= int(mode.base) < 1 << t.bits:
            raise InvalidArgumentError(f"integer multiplier {mode.base} does not fit {t.name}")
        return
    if not t.is_float:
        raise InvalidArgumentError(f"{mode.kind} is for floats, not {t.name}")
    if mode.kind == "float_quant":
        if not 0 <= mode.k <= t.mantissa:
            raise InvalidArgumentError(f"{mode.k} bits are more than the mantissa of {t.name}")
    elif not (np.isfinite(mode.base) and abs(mode.base) >= np.finfo(t.dtype).tiny):
        raise InvalidArgumentError(f"float multiplier {mode.base} is not a normal number")


def split(x: np.ndarray, t: N.NumberType, mode: Mode) -> tuple[np.ndarray, np.ndarray | None]:
    u = N.to_latent(x, t)
    if mode.kind == "classic":
        return u, None
    if mode.kind == "int_mult":
        base = t.latent.type(mode.base)
        return u // base, u % base
    if mode.kind == "float_quant":
        k, low = t.latent.type(mode.k), u & t.latent.type((1 << mode.k) - 1)
        return u >> k, np.where(u >= t.middle, low, t.latent.type((1 << mode.k) - 1) - low)
    base = t.dtype.type(mode.base)
    with np.errstate(all="ignore"):
        rank = N.int_float_rank(N.round_away(x * (t.dtype.type(1) / base)), t)
        near = N.int_float_unrank(rank, t) * base
    return rank, u - N.to_latent(near, t) + t.middle


def join(first: np.ndarray, second: np.ndarray | None, t: N.NumberType, mode: Mode) -> np.ndarray:
    """Latents of whole numbers."""
    if mode.kind == "classic":
        return first
    if mode.kind == "int_mult":
        return first * t.latent.type(mode.base) + second
    if mode.kind == "float_quant":
        k, most = t.latent.type(mode.k), t.latent.type((1 << mode.k) - 1)
        return (first << k) + np.where(first >= t.middle >> k, second, most - second)
    with np.errstate(all="ignore"):
        near = N.int_float_unrank(first, t) * t.dtype.type(mode.base)
    return N.to_latent(near, t) + second - t.middle
