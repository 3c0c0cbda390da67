"""Table-based asymmetric numeral systems, four states per page, all pages at once."""
import numpy as np

from ..errors import CorruptionError
from .numbers import bit_length

LANES = 4


class Table:
    """The states of symbols with given weights, which sum to 2**size_log."""

    def __init__(self, size_log: int, weights: np.ndarray):
        weights = np.asarray(weights, np.int64) if len(weights) else np.ones(1, np.int64)
        size = 1 << size_log
        if weights.sum() != size:
            raise CorruptionError(f"weights sum to {weights.sum()}, not {size}")
        self.size_log, self.weights = size_log, weights
        # Symbols are dealt over the states in odd strides of about 3/5 of the table.
        stride = 3 * size // 5 | 1
        spread = np.empty(size, np.int64)
        spread[(stride * np.arange(size)) & (size - 1)] = np.repeat(np.arange(len(weights)), weights)
        by_symbol = np.argsort(spread, kind="stable")
        self.first = np.cumsum(weights) - weights
        self.next_state = size + by_symbol
        rank = np.empty(size, np.int64)
        rank[by_symbol] = np.arange(size) - self.first[spread[by_symbol]]
        reach = weights[spread] + rank
        self.symbol = spread
        self.n_bits = size_log + 1 - bit_length(reach.astype(np.uint64))
        self.base = (reach << self.n_bits) - size
        self.most_bits = size_log + 1 - bit_length(weights.astype(np.uint64))
        #: For decoding, a state's bits (from bit 0), base (from 8) and symbol (from 32) in one number.
        self.entry = (self.n_bits | self.base << 8 | spread << 32).astype(np.uint64)


def encode(table: Table, symbols: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, lengths, final states) of symbols (pages, n): element i of a page
    is on lane i % 4. Lengths are 0 where not active."""
    pages, n = symbols.shape
    steps = -(-n // LANES)
    pad = ((0, 0), (0, steps * LANES - n))
    # A row for each step, with the lanes of all pages side by side.
    rows = lambda x: np.ascontiguousarray(np.pad(x, pad).reshape(pages, steps, LANES).transpose(1, 0, 2)).reshape(steps, -1)
    s, on = rows(symbols), rows(active)
    full = on.all(axis=1).tolist()
    weight, most, at = table.weights[s], table.most_bits[s], (table.first - table.weights)[s]
    values, lengths = np.empty(s.shape, np.int64), np.empty(s.shape, np.int64)
    state = np.full(pages * LANES, 1 << table.size_log, np.int64)
    for k in range(steps - 1, -1, -1):
        n_bits = lengths[k]
        np.subtract(most[k], (state >> most[k]) < weight[k], out=n_bits)
        values[k] = state
        nxt = table.next_state.take(at[k] + (state >> n_bits), mode="clip")
        state = nxt if full[k] else np.where(on[k], nxt, state)
    lengths *= on
    values &= (1 << lengths) - 1
    back = lambda x: x.reshape(steps, pages, LANES).transpose(1, 0, 2).reshape(pages, -1)[:, :n]
    return back(values), back(lengths), state.reshape(pages, LANES) - (1 << table.size_log)
