"""Bins of a latent variable: equal-count histogram, optimal merging, weights."""
from dataclasses import dataclass, field

import numpy as np

from .numbers import bit_length

#: Bits per number that a single bin, or bins without offsets, may cost more: they decode faster.
SINGLE_WORTH = TRIVIAL_WORTH = np.float32(0.1)
#: Bins whose merging costs are worked out together.
BLOCK = 256
#: The largest table (log) that training makes.
MOST_SIZE_LOG = 12


@dataclass
class Bins:
    """Bins in order. upper and count are known when trained, not when read."""

    size_log: int
    weight: np.ndarray
    lower: np.ndarray
    offset_bits: np.ndarray
    upper: np.ndarray | None = field(default=None)
    count: np.ndarray | None = field(default=None)

    def __len__(self) -> int:
        return len(self.weight)

    @property
    def trivial(self) -> bool:
        return len(self) == 0 or (len(self) == 1 and self.offset_bits[0] == 0)

    def average_bits(self) -> float:
        total = float(1 << self.size_log)
        return float(sum(w / total * (self.size_log - np.log2(w) + o) for w, o in zip(self.weight.tolist(), self.offset_bits.tolist(), strict=True)))


def histogram(ordered: np.ndarray, n_log: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(count, lower, upper) of at most 2**n_log bins of about equal count over
    sorted values; equal values are never split.

    The bins are determined by the positions where they end, so the walk goes
    from one bin's nominal end to the next and never over single values."""
    n = len(ordered)
    ends: list[int] = []
    at = opened = free = 0
    while at < n:
        target = (at << n_log) // n
        end = -(-((target + 1) * n) >> n_log)
        if end >= n:
            at = n
            break
        value = ordered[end - 1]
        left = max(at, int(np.searchsorted(ordered, value, "left")))
        right = int(np.searchsorted(ordered, value, "right"))
        # The run of equal values goes to the bin of its middle, or one earlier
        # if nothing before it waits for that one.
        own = ((left + (right - left) // 2) << n_log) // n
        if own > free:
            if left > opened:
                ends.append(left)
                opened, free = left, own
            else:
                own -= 1
        if right >= -(-((own + 1) * n) >> n_log):
            ends.append(right)
            opened, free = right, own + 1
        at = right
    if opened < n:
        ends.append(n)
    ends_a = np.array(ends, np.int64)
    starts = np.concatenate([[0], ends_a[:-1]])
    return ends_a - starts, ordered[starts], ordered[ends_a - 1]


def bin_bits(size_log: int, width: int) -> int:
    """Bits of one bin in a chunk's metadata."""
    return size_log + width + int(width).bit_length()


def merge_cost(count: np.ndarray, lower: np.ndarray, upper: np.ndarray, total: float, meta_bits: float) -> np.ndarray:
    """Estimated bits of bins, their metadata included."""
    c = count.astype(np.float32)
    spread = bit_length(upper - lower).astype(np.float32)
    return np.float32(meta_bits) + (np.log2(np.float32(total)) - np.log2(c) + spread) * c


def merge(count: np.ndarray, lower: np.ndarray, upper: np.ndarray, size_log: int, width: int) -> list[tuple[int, int]]:
    """The cheapest partition of neighbouring bins into ranges [first, last]."""
    n, total, meta = len(count), int(count.sum()), bin_bits(size_log, width)
    before = np.concatenate([[0], np.cumsum(count)])
    best = np.zeros(n + 1, np.float32)
    start = np.zeros(n, np.int64)
    for at in range(0, n, BLOCK):
        # Costs of all ranges that end in a block of bins; a range can't begin after its end.
        last = np.arange(at, min(n, at + BLOCK))
        first = np.arange(last[-1] + 1)[:, None]
        counts = np.maximum(before[last + 1] - before[first], 1)
        own = merge_cost(counts, np.minimum(lower[first], upper[last]), upper[last], total, meta)
        for k, i in enumerate(last.tolist()):
            cost = best[: i + 1] + own[: i + 1, k]
            j = i - int(np.argmin(cost[::-1]))
            best[i + 1], start[i] = cost[j], j
    single = merge_cost(np.array([total]), lower[:1], upper[-1:], total, meta)[0]
    if single < best[n] + SINGLE_WORTH * np.float32(total):
        return [(0, n - 1)]
    if (lower == upper).all() and merge_cost(count, lower, upper, total, meta).sum() < best[n] + TRIVIAL_WORTH * np.float32(total):
        return [(i, i) for i in range(n)]
    out, i = [], n - 1
    while i >= 0:
        out.append((int(start[i]), i))
        i = int(start[i]) - 1
    return out[::-1]


def quantize(count: np.ndarray, total: int, most_log: int) -> tuple[int, np.ndarray]:
    """(size_log, weights): weights of at least 1 that sum to 2**size_log, near
    to proportional to count; common powers of two are taken out."""
    n = len(count)
    if n == 1:
        return 0, np.ones(1, np.int64)
    log = max(most_log, (n - 1).bit_length())
    size = 1 << log
    wish = np.maximum(count.astype(np.float32) * np.float32(size / total) - np.float32(1), np.float32(0))
    scale = np.float32(size - n) / wish.sum(dtype=np.float32) if wish.any() else np.float32(0)
    ideal = np.float32(1) + wish * scale
    weight = np.floor(ideal + np.float32(0.5)).astype(np.int64)
    surplus = int(weight.sum()) - size
    if surplus > 0:
        weight[np.flatnonzero((weight > 1) & (weight > ideal))[:surplus]] -= 1
    elif surplus < 0:
        weight[np.flatnonzero(weight < ideal)[:-surplus]] += 1
    common = int((weight & -weight).min()).bit_length() - 1
    return log - common, weight >> common


def bins_log(level: int, n: int) -> int:
    """Log of the number of bins before merging."""
    fast = max(0, n.bit_length() - 1 - 4)
    return level if level <= fast else fast + (level - fast) // 2


def train(latents: np.ndarray, n_log: int, width: int) -> Bins:
    n = len(latents)
    if not n:
        none = np.zeros(0, np.int64)
        return Bins(0, none, latents, none, latents, none)
    count, lower, upper = histogram(np.sort(latents), n_log)
    size_log = min(n_log + 2, MOST_SIZE_LOG, (n - 1).bit_length())
    parts = merge(count, lower, upper, size_log, width)
    first, last = (np.array(x) for x in zip(*parts, strict=True))
    before = np.concatenate([[0], np.cumsum(count)])
    own = before[last + 1] - before[first]
    size_log, weight = quantize(own, n, size_log)
    return Bins(size_log, weight, lower[first], bit_length(upper[last] - lower[first]), upper[last], own)
