"""Delta encodings of one page of latents."""
import numpy as np

from ..errors import CorruptionError
from .config import Delta
from .numbers import bit_length

#: Lags that a lookback may choose from, beside those found in the data.
NEAR = 6
FOUND = 10


def middle(dtype: np.dtype) -> np.unsignedinteger:
    return dtype.type(1 << (dtype.itemsize * 8 - 1))


def encode(u: np.ndarray, delta: Delta, lags: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(state, stored) of a page."""
    if delta.kind == "none":
        return u[:0], u
    if delta.kind == "consecutive":
        state = np.zeros(delta.order, u.dtype)
        for i in range(delta.order):
            state[i] = u[0] if len(u) else 0
            u = u[1:] - u[:-1]
        return state, u + middle(u.dtype)
    n = delta.state_n
    state = np.zeros(n, u.dtype)
    own = min(n, len(u))
    state[n - own :] = u[:own]
    at = np.arange(own, len(u))
    return state, u[own:] - u[at - lags] + middle(u.dtype)


def decode(state: np.ndarray, stored: np.ndarray, n: int, delta: Delta, lags: np.ndarray | None = None) -> np.ndarray:
    """The n latents of a page."""
    if delta.kind == "none":
        return stored
    d = stored - middle(stored.dtype)
    if delta.kind == "consecutive":
        for m in state[::-1]:
            d = np.cumsum(np.concatenate([[m], d]).astype(d.dtype), dtype=d.dtype)
        return d[:n]
    k = delta.state_n
    if len(lags) and (lags.max() > 1 << delta.window_log or lags.min() < 1):
        raise CorruptionError("lookback outside of its window")
    # Every latent is the sum of the deltas on its way back to the state (or to
    # the zeros before it); the ways are shortened by doubling.
    out = np.concatenate([state, d]).astype(d.dtype)
    up = np.concatenate([np.full(k, -1, np.int64), np.arange(k, k + len(d)) - lags.astype(np.int64)])
    up[up < 0] = -1
    alive = np.flatnonzero(up >= 0)
    while len(alive):
        to = up[alive]
        add, nxt = out[to], up[to]
        out[alive] += add
        up[alive] = nxt
        alive = alive[nxt >= 0]
    # A page shorter than its state has zeros on the left.
    return out[max(0, k - n) :][:n] if n < k else out[:n]


def decode_equal(state: np.ndarray, stored: np.ndarray, n: int) -> np.ndarray:
    """Consecutive deltas of pages of n numbers each: (pages, order) moments and
    (pages, stored) deltas."""
    d = stored - middle(stored.dtype)
    for i in range(state.shape[1] - 1, -1, -1):
        d = np.cumsum(np.concatenate([state[:, i : i + 1], d], axis=1), axis=1, dtype=d.dtype)
    return d[:, :n]


def window_log(n: int) -> int:
    return int(np.clip((n - 1).bit_length(), 4, 15))


def choose_lags(u: np.ndarray, delta: Delta) -> np.ndarray:
    """A lag for each latent after the state: of some near lags and of those at
    which sampled values recur most, the one with the smallest difference,
    frequent lags preferred."""
    n, k = len(u), delta.state_n
    if n <= k:
        return np.zeros(0, np.int64)
    most = min(1 << delta.window_log, n - 1)
    lags = list(range(1, min(NEAR, most) + 1))
    for shift in (0, 8):
        _, group = np.unique(u >> u.dtype.type(shift) if shift < u.dtype.itemsize * 8 else u * 0, return_inverse=True)
        order = np.argsort(group, kind="stable")
        gap = np.diff(order)[np.diff(group[order]) == 0]
        gap = gap[gap <= most]
        if len(gap):
            values, times = np.unique(gap, return_counts=True)
            lags += values[np.argsort(-times, kind="stable")[:FOUND]].tolist()
    lags = np.array(list(dict.fromkeys(lags)), np.int64)
    at = np.arange(k, n)
    cost = np.full((len(lags), len(at)), 1 << 20)
    for i, lag in enumerate(lags):
        ok = at >= lag
        d = u[at[ok]] - u[at[ok] - lag]
        cost[i, ok] = bit_length(np.minimum(d, (~d) + d.dtype.type(1)))
    first = cost.argmin(axis=0)
    use = np.bincount(first, minlength=len(lags))
    rare = np.round(np.log2(len(at) + 1.0) - np.log2(use + 1.0)).astype(np.int64)
    return lags[(cost + rare[:, None]).argmin(axis=0)]
