"""Samples of a chunk on which modes and deltas are chosen."""
import numpy as np

_M = (1 << 64) - 1


class Xoroshiro:
    """The public generator xoroshiro128++ seeded by splitmix64."""

    def __init__(self, seed: int = 0):
        def split(i: int) -> int:
            z = (seed + i * 0x9E3779B97F4A7C15) & _M
            z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & _M
            z = ((z ^ z >> 27) * 0x94D049BB133111EB) & _M
            return z ^ z >> 31

        self.a, self.b = split(1), split(2)

    def next(self) -> int:
        rot = lambda x, k: (x << k | x >> 64 - k) & _M
        a, b = self.a, self.b
        out = (rot((a + b) & _M, 17) + a) & _M
        b ^= a
        self.a, self.b = rot(a, 49) ^ b ^ (b << 21) & _M, rot(b, 28)
        return out


def size(n: int) -> int:
    """Numbers to sample of n; 0 where n is too small."""
    return 0 if n < 10 else 10 + (n - 10) // 40


def choose(x: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray | None:
    """A random sample without repetition; of what keep rejects nothing is
    taken. None if fewer than 10 are found."""
    n, target = len(x), size(len(x))
    if not target:
        return None
    at = _outputs(4 * target) % np.uint64(n)
    at = at[np.sort(np.unique(at, return_index=True)[1])].astype(np.int64)
    if keep is not None:
        at = at[keep[at]]
    return x[at[:target]] if len(at) >= 10 else None


_RNG, _SEEN = Xoroshiro(), []


def _outputs(n: int) -> np.ndarray:
    """The generator's first n outputs for seed 0, which every sample starts from."""
    _SEEN.extend(_RNG.next() for _ in range(n - len(_SEEN)))
    return np.array(_SEEN[:n], np.uint64)


def delta_positions(n: int, group: int = 200, extra: int | None = None) -> np.ndarray:
    """Positions of the sample for the choice of a delta: a group at the start
    and further ones evenly spread."""
    extra = 1 + n // 10_000 if extra is None else extra
    gap = max(0, n - (extra + 1) * group) // extra if extra else 0
    starts = np.arange(extra + 1) * (group + gap)
    at = (starts[:, None] + np.arange(group)).reshape(-1)
    return at[at < n]
