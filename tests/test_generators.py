"""Round trips over synthetic sequences of many kinds, and ratios that they must reach."""
import numpy as np
import pytest

from tessera import standalone
from tessera.kernel import numbers as N

COUNT = 20_000
RNG = np.random.default_rng(0)


def heavy_cents():
    base = np.floor(RNG.pareto(1.2, COUNT) * 10).clip(max=1e6)
    return (base * 100 + RNG.choice([0, 25, 49, 50, 95, 99], COUNT)).astype(np.int64)


def interleaved(kind):
    level = np.arange(10) * 1_000_000
    walk = np.cumsum(RNG.integers(-50, 51, (COUNT // 10, 10)), axis=0) if kind else RNG.integers(0, 1000, (COUNT // 10, 10))
    x = level + walk
    if kind == "scrambled":
        x = np.array([r[RNG.permutation(10)] for r in x])
    return x.reshape(-1).astype(np.int64)


MAKE = {
    "geo": lambda: RNG.geometric(0.001, COUNT).astype(np.int64),
    "lomax_i32": lambda: (RNG.pareto(0.5, COUNT) * 333).clip(max=2e9).astype(np.int32),
    "lomax_u32": lambda: (RNG.pareto(0.5, COUNT) * 333).clip(max=4e9).astype(np.uint32),
    "uniform": lambda: RNG.integers(-(2**63), 2**63 - 1, COUNT),
    "constant": lambda: np.full(COUNT, 77777, np.int64),
    "sparse": lambda: (RNG.random(COUNT) < 0.01).astype(np.int64),
    "dollars": lambda: heavy_cents() // 100,
    "cents": lambda: heavy_cents() % 100,
    "total_cents": heavy_cents,
    "slow_cosine_i64": lambda: (1e5 * np.cos(np.arange(COUNT) * 2 * np.pi * 103 / COUNT)).astype(np.int64),
    "slow_cosine_f64": lambda: 1e5 * np.cos(np.arange(COUNT) * 2 * np.pi * 103 / COUNT),
    "normal_f64": lambda: RNG.normal(size=COUNT),
    "normal_f32": lambda: RNG.normal(size=COUNT).astype(np.float32),
    "normal_f16": lambda: RNG.normal(size=COUNT).astype(np.float16),
    "log_normal": lambda: np.exp(RNG.normal(size=COUNT)).astype(np.float32),
    "csum": lambda: np.cumsum(np.exp(RNG.normal(size=COUNT)) - np.exp(0.5)).astype(np.float32),
    "near_linear": lambda: np.cumsum(1_000_000 + RNG.integers(0, 1_000_000, COUNT)),
    "millis": lambda: RNG.integers(0, 10**12, COUNT) * 1000,
    "integers": lambda: RNG.integers(0, 2**30, COUNT).astype(np.float64),
    "quantized_normal": lambda: RNG.normal(size=COUNT).astype(np.float32).astype(np.float64),
    "decimal": lambda: np.round(RNG.normal(scale=1000, size=COUNT)) / 100,
    "radians": lambda: (np.arange(COUNT) + 10) * np.pi,
    "interl0": lambda: interleaved(""),
    "interl1": lambda: interleaved("walk"),
    "interl_scrambl1": lambda: interleaved("scrambled"),
    "dist_shift": lambda: (RNG.normal(size=COUNT) * np.exp(np.arange(COUNT) / 2000)).astype(np.int64),
}
#: Plain bytes over compressed ones.
LEAST = {"constant": 1000, "sparse": 200, "near_linear": 2.5, "millis": 1.4, "decimal": 2.4, "quantized_normal": 1.9, "integers": 1.9, "radians": 20, "slow_cosine_i64": 4, "cents": 20, "uniform": 0.99}


@pytest.mark.parametrize("name", list(MAKE))
def test_generator(name):
    x = MAKE[name]()
    data = standalone.compress(x)
    y = standalone.decompress(data)
    t = N.type_of(x)
    assert N.to_latent(x, t).tobytes() == N.to_latent(y, t).tobytes()
    assert x.nbytes / len(data) >= LEAST.get(name, 1.0), x.nbytes / len(data)
