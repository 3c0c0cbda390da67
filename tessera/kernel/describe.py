"""What the latents of a chunk mean: a name, a unit and a text for each value."""
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from . import numbers as N
from .chunk import ChunkMeta


@dataclass(frozen=True)
class Description:
    name: str
    unit: str
    number: Callable[[np.ndarray], np.ndarray]  # latents to the numbers they stand for

    def texts(self, latents: np.ndarray) -> list[str]:
        return [str(x) for x in self.number(latents).tolist()]


def _plain(u: np.ndarray) -> np.ndarray:
    return u


def _around(center: int) -> Callable[[np.ndarray], np.ndarray]:
    """Signed distance to center, exact for every width."""

    def run(u: np.ndarray) -> np.ndarray:
        return (u - u.dtype.type(center)).view(np.dtype(f"i{u.dtype.itemsize}"))

    return run


def _quantum(t: N.NumberType, k: int) -> Callable[[np.ndarray], np.ndarray]:
    """The float at the lower end of a quantum's latents: with its cut bits at zero
    above the middle, and at one below it."""

    def run(u: np.ndarray) -> np.ndarray:
        top = u << t.latent.type(k)
        negative = top < t.middle
        size = N.from_latent(np.where(negative, ~top, top), t)
        return np.where(negative, -size, size)

    return run


def describe(meta: ChunkMeta) -> dict[str, Description]:
    """Descriptions by latent variable. A variable that is stored as differences is
    described as those, around the middle of its type."""
    t, mode = meta.ntype, meta.mode
    middle, zero = int(t.middle), int(t.middle) if t.dtype.kind == "i" else 0
    number = lambda u: N.from_latent(u, t)
    signed = _around if t.dtype.kind == "i" else lambda _: _plain
    base = mode.base if mode.base is not None else 1
    # Names and units by mode, for plain variables and for differences.
    primary = {
        "classic": (Description("primary", "", number), ("delta", " ULPs" if t.is_float else "")),
        "int_mult": (Description(f"multiplier [x{base}]", "x", signed(zero // int(base)) if mode.kind == "int_mult" else _plain), (f"multiplier delta [x{base}]", "x")),
        "float_mult": (Description(f"multiplier [x{base}]", "x", lambda u: N.int_float_unrank(u, t)), (f"multiplier delta [x{base}]", "x")),
        "float_quant": (Description("quantized", "", _quantum(t, mode.k)), (f"quantums delta [<<{mode.k}]", "q")),
    }[mode.kind]
    secondary = {
        "classic": None,
        "int_mult": (Description("adjustment", "", lambda u: u - u.dtype.type(zero % int(base))), ("adjustment delta", "")),
        "float_mult": (Description("adjustment", " ULPs", _around(middle)), ("adjustment delta", "")),
        "float_quant": (Description("magnitude adjustment", " ULPs", _plain), ("magnitude adjustment delta", "")),
    }[mode.kind]
    out = {}
    if meta.delta.kind == "lookback":
        out["delta"] = Description("lookback", "", _plain)
    for var, told in (("primary", primary), ("secondary", secondary)):
        if told:
            out[var] = told[0] if meta.own_delta(var).kind == "none" else Description(*told[1], _around(middle))
    return out
