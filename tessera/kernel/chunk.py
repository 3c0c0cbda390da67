"""A chunk: metadata and pages, to bytes and back."""
from dataclasses import dataclass

import numpy as np

from ..errors import CompatibilityError, CorruptionError, InsufficientDataError, InvalidArgumentError
from . import bins as B
from . import choose, deltas, modes, sample, tans
from . import numbers as N
from .bitio import Reader, Windows, Writer, pack
from .config import BATCH, ChunkConfig, Delta, DeltaSpec, Mode

FORMAT = 3
SECONDARY_BINS_LOG = 6
#: What a lookback must save in bytes per number of the sample.
LOOKBACK_WORTH = 0.25
MOST_TABLE_LOG = 14
VARS = ("delta", "primary", "secondary")


@dataclass
class ChunkMeta:
    ntype: N.NumberType
    mode: Mode
    delta: Delta
    bins: dict[str, B.Bins]  # by latent variable, in the order of VARS

    def width(self, var: str) -> int:
        return 32 if var == "delta" else self.ntype.bits

    def latent(self, var: str) -> np.dtype:
        return N.U32.latent if var == "delta" else self.ntype.latent

    def own_delta(self, var: str) -> Delta:
        if var == "primary" or (var == "secondary" and self.delta.secondary):
            return self.delta
        return Delta()

    def stored(self, var: str, n: int) -> int:
        """Stored latents of a page of n numbers."""
        return max(0, n - (self.delta.state_n if var == "delta" else self.own_delta(var).state_n))


# Numbers of modes and delta encodings in a file.
MODE_CODES = {"classic": 0, "int_mult": 1, "float_mult": 2, "float_quant": 3}
DELTA_CODES = {"none": 0, "consecutive": 1, "lookback": 2}


def meta_bits(meta: ChunkMeta) -> int:
    """Exact bits of a chunk's metadata before padding."""
    t = meta.ntype
    n = 4 + {"classic": 0, "float_quant": 8}.get(meta.mode.kind, t.bits) + 4 + {"none": 0, "consecutive": 4, "lookback": 10}[meta.delta.kind]
    return n + sum(19 + len(b) * B.bin_bits(b.size_log, meta.width(v)) for v, b in meta.bins.items())


def page_meta_bits(meta: ChunkMeta) -> int:
    return sum(meta.own_delta(v).state_n * meta.width(v) + 4 * b.size_log for v, b in meta.bins.items())


def write_meta(meta: ChunkMeta) -> bytes:
    w, t = Writer(), meta.ntype
    w.bits(MODE_CODES[meta.mode.kind], 4)
    if meta.mode.kind == "float_quant":
        w.bits(meta.mode.k, 8)
    elif meta.mode.kind == "int_mult":
        w.bits(meta.mode.base, t.bits)
    elif meta.mode.kind == "float_mult":
        w.bits(int(N.to_latent(np.array([meta.mode.base], t.dtype), t)[0]), t.bits)
    w.bits(DELTA_CODES[meta.delta.kind], 4)
    if meta.delta.kind == "consecutive":
        w.bits(meta.delta.order, 3)
        w.bits(meta.delta.secondary, 1)
    elif meta.delta.kind == "lookback":
        w.bits(meta.delta.window_log - 1, 5)
        w.bits(meta.delta.state_log, 4)
        w.bits(meta.delta.secondary, 1)
    for var, b in meta.bins.items():
        width = meta.width(var)
        w.bits(b.size_log, 4)
        w.bits(len(b), 15)
        for weight, lower, offset in zip(b.weight.tolist(), b.lower.tolist(), b.offset_bits.tolist(), strict=True):
            w.bits(weight - 1, b.size_log)
            w.bits(lower, width)
            w.bits(offset, width.bit_length())
    return w.bytes()


def read_meta(r: Reader, t: N.NumberType, version: int = FORMAT) -> ChunkMeta:
    code = r.bits(4)
    kind = {v: k for k, v in MODE_CODES.items()}.get(code)
    if kind is None:
        raise CorruptionError(f"unknown mode {code}")
    mode = Mode(kind)
    if kind == "float_quant":
        mode = Mode(kind, k=r.bits(8))
    elif kind != "classic":
        base = r.bits(t.bits)
        if kind == "int_mult" and version == 0:
            raise CompatibilityError("multipliers of format 0 can't be read")
        mode = Mode(kind, base if kind == "int_mult" else float(N.from_latent(np.array([base], t.latent), t)[0]) if t.is_float else base)
    try:
        modes.check(mode, t)
    except InvalidArgumentError as e:
        raise CorruptionError(str(e)) from e
    delta = _read_delta(r, version)
    names = [v for v, there in zip(VARS, (delta.kind == "lookback", True, kind != "classic"), strict=True) if there]
    meta = ChunkMeta(t, mode, delta, {})
    for var in names:
        width = meta.width(var)
        size_log, n = r.bits(4), r.bits(15)
        if 1 << size_log < n or (n == 1 and size_log) or size_log > MOST_TABLE_LOG:
            raise CorruptionError(f"{n} bins with a table of 2^{size_log}")
        rows = [(r.bits(size_log) + 1, r.bits(width), r.bits(width.bit_length())) for _ in range(n)]
        weight, lower, offset = (np.array([x[i] for x in rows], d) for i, d in enumerate((np.int64, meta.latent(var), np.int64)))
        if n and offset.max() > width:
            raise CorruptionError("an offset is wider than its type")
        if var == "delta" and n and not (lower.min() >= 1 and lower.max() <= 1 << delta.window_log):
            raise CorruptionError("lookback bins outside of the window")
        if n and weight.sum() != 1 << size_log:
            raise CorruptionError("weights don't fill the table")
        meta.bins[var] = B.Bins(size_log, weight, lower, offset)
    r.align()
    return meta


def _read_delta(r: Reader, version: int) -> Delta:
    if version < 3:
        order = r.bits(3)
        return Delta("consecutive", order) if order else Delta()
    code = r.bits(4)
    if code == 0:
        return Delta()
    if code == 1:
        order, secondary = r.bits(3), bool(r.bits(1))
        if not order:
            raise CorruptionError("consecutive deltas of order 0")
        return Delta("consecutive", order, secondary=secondary)
    if code == 2:
        window, state, secondary = 1 + r.bits(5), r.bits(4), bool(r.bits(1))
        if state > window:
            raise CorruptionError("a lookback's state is larger than its window")
        return Delta("lookback", window_log=window, state_log=state, secondary=secondary)
    raise CorruptionError(f"unknown delta encoding {code}")


# -- compression -----------------------------------------------------------


@dataclass
class Candidate:
    """A chunk with mode and delta applied and bins trained, not yet in bytes."""

    meta: ChunkMeta
    page_n: list[int]
    states: dict[str, list[np.ndarray]]
    stored: dict[str, list[np.ndarray]]

    def worst_bits(self) -> int:
        bits = 0
        for b in self.meta.bins.values():
            for c, w, o in zip(b.count.tolist(), b.weight.tolist(), b.offset_bits.tolist(), strict=True):
                bits += c * (o + b.size_log - (w.bit_length() - 1))
        return bits

    def expected_bytes(self) -> float:
        body = sum(sum(map(len, self.stored[v])) * b.average_bits() for v, b in self.meta.bins.items())
        return -(-meta_bits(self.meta) // 8) + len(self.page_n) * -(-page_meta_bits(self.meta) // 8) + body / 8


def candidate(first: np.ndarray, second: np.ndarray | None, t: N.NumberType, mode: Mode, delta: Delta, page_n: list[int], n_log: int) -> Candidate:
    meta = ChunkMeta(t, mode, delta, {})
    parts = {"primary": first} | ({} if second is None else {"secondary": second})
    names = [v for v in VARS if v in parts or (v == "delta" and delta.kind == "lookback")]
    states: dict[str, list] = {v: [] for v in names}
    stored: dict[str, list] = {v: [] for v in names}
    at = 0
    for n in page_n:
        lags = deltas.choose_lags(first[at : at + n], delta) if delta.kind == "lookback" else None
        if lags is not None:
            states["delta"].append(np.zeros(0, np.uint32))
            stored["delta"].append(lags.astype(np.uint32))
        for v, u in parts.items():
            state, kept = deltas.encode(u[at : at + n], meta.own_delta(v), lags)
            states[v].append(state)
            stored[v].append(kept)
        at += n
    for v in names:
        log = min(n_log, SECONDARY_BINS_LOG) if v == "secondary" else n_log
        meta.bins[v] = B.train(np.concatenate(stored[v]), log, meta.width(v))
    return Candidate(meta, page_n, states, stored)


def choose_delta(first: np.ndarray, t: N.NumberType, n_log: int) -> Delta:
    some = first[sample.delta_positions(len(first))]
    size = lambda d: candidate(some, None, t, Mode(), d, [len(some)], n_log).expected_bytes()
    best, cost = Delta(), size(Delta())
    worth = LOOKBACK_WORTH * len(some)
    if cost > worth:
        back = size(Delta("lookback", window_log=deltas.window_log(len(some)))) + worth
        if back < cost:
            best, cost = Delta("lookback", window_log=deltas.window_log(len(first))), back
    for order in range(1, 8):
        own = size(Delta("consecutive", order))
        if own >= cost:
            break
        best, cost = Delta("consecutive", order), own
    return best


def delta_for(first: np.ndarray, t: N.NumberType, spec: DeltaSpec, n_log: int) -> Delta:
    if spec.kind == "auto":
        return choose_delta(first, t, n_log)
    if spec.kind == "consecutive" and spec.order:
        return Delta("consecutive", spec.order)
    if spec.kind == "lookback":
        return Delta("lookback", window_log=deltas.window_log(len(first)))
    return Delta()


def guarantee(t: N.NumberType, n: int) -> int:
    """Bytes that a chunk of one page never exceeds: a one-bin chunk, verbatim."""
    return -(-(8 + 19 + B.bin_bits(0, t.bits)) // 8) + n * (t.bits // 8)


def plan(x: np.ndarray, t: N.NumberType, config: ChunkConfig) -> Candidate:
    """Choose mode, delta and bins for a chunk."""
    n = len(x)
    config.check(n)
    page_n = config.paging.counts(n)
    mode = choose.mode_for(x, t, config.mode)
    first, second = modes.split(x, t, mode)
    n_log = B.bins_log(config.level, n)
    got = candidate(first, second, t, mode, delta_for(first, t, config.delta, n_log), page_n, n_log)
    worst = -(-meta_bits(got.meta) // 8) + len(page_n) * (1 + -(-page_meta_bits(got.meta) // 8)) + -(-got.worst_bits() // 8)
    return got if worst <= guarantee(t, n) else verbatim(x, t, page_n)


def verbatim(x: np.ndarray, t: N.NumberType, page_n: list[int]) -> Candidate:
    u = N.to_latent(x, t)
    one = B.Bins(0, np.ones(1, np.int64), np.zeros(1, t.latent), np.array([t.bits]), np.full(1, np.iinfo(t.latent).max, t.latent), np.array([len(x)]))
    at = np.cumsum(page_n)[:-1]
    return Candidate(ChunkMeta(t, Mode(), Delta(), {"primary": one}), page_n, {"primary": [u[:0]] * len(page_n)}, {"primary": np.split(u, at)})


def write_pages(c: Candidate) -> list[bytes]:
    """The bytes of all pages; the pages go through every step together."""
    pages, batches = len(c.page_n), -(-max(c.page_n) // BATCH)
    values, lengths, heads = [], [], [Writer() for _ in range(pages)]
    for var, b in c.meta.bins.items():
        kept, width = c.stored[var], c.meta.width(var)
        grid = np.zeros((pages, batches * BATCH), c.meta.latent(var))
        on = np.arange(batches * BATCH) < np.array([len(k) for k in kept])[:, None]
        grid[on] = np.concatenate(kept)
        if len(b):
            symbol = np.clip(np.searchsorted(b.lower, grid, "right") - 1, 0, len(b) - 1)
            offset = np.where(on, grid - b.lower[symbol], 0).astype(np.uint64)
            n_off = np.where(on, b.offset_bits[symbol], 0)
        else:
            symbol, offset, n_off = np.zeros(grid.shape, np.int64), grid.astype(np.uint64), np.zeros(grid.shape, np.int64)
        if len(b) > 1:
            value, n_ans, final = tans.encode(tans.Table(b.size_log, b.weight), symbol, on)
        else:
            value = n_ans = np.zeros(grid.shape, np.int64)
            final = np.zeros((pages, tans.LANES), np.int64)
        values += [value.astype(np.uint64).reshape(pages, batches, BATCH), offset.reshape(pages, batches, BATCH)]
        lengths += [n_ans.reshape(pages, batches, BATCH), n_off.reshape(pages, batches, BATCH)]
        for w, state, lanes in zip(heads, c.states[var], final.tolist(), strict=True):
            for s in state.tolist():
                w.bits(s, width)
            for lane in lanes:
                w.bits(lane, b.size_log)
    v = np.stack(values, axis=2).reshape(pages, -1)
    n = np.stack(lengths, axis=2).reshape(pages, -1)
    size = -(-n.sum(axis=1) // 8) * 8
    start = np.cumsum(size) - size
    at = start[:, None] + np.cumsum(n, axis=1) - n
    body = pack(v.reshape(-1), n.reshape(-1), at.reshape(-1), int(size.sum())).tobytes()
    return [w.bytes() + body[s // 8 : (s + k) // 8] for w, s, k in zip(heads, start.tolist(), size.tolist(), strict=True)]


def compress(x: np.ndarray, t: N.NumberType | None = None, config: ChunkConfig | None = None) -> tuple[bytes, list[bytes], Candidate]:
    """(metadata, pages, plan) of a chunk."""
    t = t or N.type_of(x)
    c = plan(np.ascontiguousarray(x), t, config or ChunkConfig())
    return write_meta(c.meta), write_pages(c), c


# -- decompression ---------------------------------------------------------


def read_pages(meta: ChunkMeta, pages: list[bytes], counts: list[int], whole: bool = True, at: int = 0) -> tuple[list[np.ndarray], int]:
    """The numbers of pages, decoded in lockstep: one step of the entropy coder
    takes four symbols of every page. With whole=False there is one page that
    begins at byte ``at`` and may be followed by other data. Also returns the
    byte after the last page."""
    t = meta.ntype
    states: dict[str, list[list[int]]] = {v: [] for v in meta.bins}
    lanes: dict[str, list[list[int]]] = {v: [] for v in meta.bins}
    starts, ends, base, blobs = [], [], 0, []
    for blob, n in zip(pages, counts, strict=True):
        r = Reader(blob, at)
        for v, b in meta.bins.items():
            if not len(b) and meta.stored(v, n):
                raise CorruptionError("numbers but no bins")
            states[v].append([r.bits(meta.width(v)) for _ in range(meta.own_delta(v).state_n)])
            lanes[v].append([r.bits(b.size_log) for _ in range(tans.LANES)])
        r.align()
        starts.append(base + r.bit)
        ends.append(base + len(blob) * 8)
        blobs.append(np.frombuffer(blob, np.uint8))
        base += len(blob) * 8
    data = Windows(np.concatenate(blobs) if blobs else np.zeros(0, np.uint8))
    pos, end, n_page = np.array(starts, np.int64), np.array(ends, np.int64), np.array(counts, np.int64)
    batches = -(-int(n_page.max(initial=0)) // BATCH)
    out = {v: np.zeros((len(pages), batches * BATCH), meta.latent(v)) for v in meta.bins}
    tables = {v: tans.Table(b.size_log, b.weight) for v, b in meta.bins.items() if len(b) > 1}
    state = {v: np.ascontiguousarray(np.array(lanes[v], np.intp).reshape(-1, tans.LANES).T) for v in meta.bins}
    kept = {v: np.array([meta.stored(v, n) for n in counts], np.int64) for v in meta.bins}
    for k in range(batches):
        for v, b in meta.bins.items():
            here = np.clip(kept[v] - k * BATCH, 0, BATCH)
            rows = np.flatnonzero(here)
            if not len(rows):
                continue
            most = int(here.max())
            if v in tables:
                symbol, pos[rows] = _symbols(tables[v], data, state[v], rows, pos[rows], here[rows], most)
            else:
                symbol = np.zeros((len(rows), most), np.int64)
            on = np.arange(most) < here[rows, None]
            n_off = np.where(on, b.offset_bits[symbol], 0)
            where = pos[rows, None] + np.cumsum(n_off, axis=1) - n_off
            if b.offset_bits.any():
                offset = data.read(where, n_off).astype(out[v].dtype)
            else:
                offset = np.zeros(n_off.shape, out[v].dtype)
            out[v][rows, k * BATCH : k * BATCH + most] = np.where(on, b.lower[symbol] + offset, 0)
            pos[rows] += n_off.sum(axis=1)
        if (pos > end).any():
            raise InsufficientDataError("a page ends early")
    rest = -pos % 8
    if (data.read(pos, rest) != 0).any():
        raise CorruptionError("padding bits are not zero")
    pos += rest
    if whole and (pos != end).any():
        raise CorruptionError("a page has bytes to spare")
    return _joined(meta, states, out, kept, counts), int(pos[-1] // 8) if len(pages) else 0


def _joined(meta: ChunkMeta, states: dict, out: dict, kept: dict, counts: list[int]) -> list[np.ndarray]:
    """Numbers of pages from their stored latents; modes are joined for all pages at once."""
    t, got = meta.ntype, {}
    same = len(set(counts)) == 1
    for v in meta.bins:
        delta = meta.own_delta(v)
        if v == "delta":
            continue
        if delta.kind == "none":
            got[v] = out[v][np.arange(out[v].shape[1]) < kept[v][:, None]]
        elif delta.kind == "consecutive" and same:
            got[v] = deltas.decode_equal(np.array(states[v], meta.latent(v)), out[v][:, : kept[v][0]], counts[0]).reshape(-1)
        else:
            lags = [out["delta"][i, :k].astype(np.int64) for i, k in enumerate(kept["delta"])] if "delta" in out else [None] * len(counts)
            got[v] = np.concatenate([deltas.decode(np.array(states[v][i], meta.latent(v)), out[v][i, : kept[v][i]], n, delta, lags[i]) for i, n in enumerate(counts)] or [np.zeros(0, meta.latent(v))])
    x = N.from_latent(modes.join(got["primary"], got.get("secondary"), t, meta.mode), t)
    return np.split(x, np.cumsum(counts)[:-1])


def _symbols(table: tans.Table, data: Windows, state: np.ndarray, rows: np.ndarray, pos: np.ndarray, here: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The next symbols of the pages ``rows``, and where their bits end. The bits of
    the four lanes of a step are side by side and at most 56, so one window of the
    data serves all of them; lanes are rows, so that every operation is on
    contiguous numbers."""
    steps = -(-most // tans.LANES)
    lanes = np.arange(tans.LANES)[:, None]
    entry, words = table.entry, data.words
    s = state[:, rows]
    n, last = len(rows), len(words) - 1
    seen = np.empty((steps, tans.LANES, n), np.uint64)
    shift = np.zeros((tans.LANES, n), np.uint64)
    value = np.empty((tans.LANES, n), np.uint64)
    at = pos.astype(np.uint64)
    full = int(here.min()) == steps * tans.LANES
    for k in range(steps):
        e = seen[k]
        np.take(entry, s, out=e, mode="clip")
        n_bits = e & _BITS
        if not full:
            on = k * tans.LANES + lanes < here
            n_bits *= on
        np.cumsum(n_bits[:-1], axis=0, out=shift[1:])
        window = words[np.minimum(at >> _THREE, last).astype(np.intp)] >> (at & _SEVEN)
        np.right_shift(window, shift, out=value)
        value &= (_ONE << n_bits) - _ONE
        value += (e >> _BASE) & _BASE_BITS
        at += shift[-1]
        at += n_bits[-1]
        s = value.astype(np.intp) if full else np.where(on, value.astype(np.intp), s)
    state[:, rows] = s
    symbol = (seen >> _SYMBOL).astype(np.intp).transpose(2, 0, 1).reshape(n, -1)
    return symbol[:, :most], at.astype(np.int64)


# Places of the fields of a table's entry.
_ONE, _THREE, _SEVEN = np.uint64(1), np.uint64(3), np.uint64(7)
_BITS, _BASE, _BASE_BITS, _SYMBOL = np.uint64(63), np.uint64(8), np.uint64((1 << 24) - 1), np.uint64(32)
