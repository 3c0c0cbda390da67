"""Golden vectors, round trips, truncation, corruption and size bounds of the codec."""
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera import standalone as S
from tessera.errors import CodecError, CorruptionError, InsufficientDataError, InvalidArgumentError
from tessera.kernel import bins, choose, deltas, modes, sample, tans
from tessera.kernel import chunk as C
from tessera.kernel import numbers as N
from tessera.kernel.bitio import Reader, pack
from tessera.kernel.config import ChunkConfig, Delta, DeltaSpec, Mode, ModeSpec, Paging

RNG = np.random.default_rng(5)


def same(x, y):
    t = N.type_of(x)
    return len(x) == len(y) and N.to_latent(x, t).tobytes() == N.to_latent(y.astype(x.dtype), t).tobytes()


def config(level=8, mode="auto", delta="auto", page=1 << 18):
    return ChunkConfig(level, ModeSpec.parse(mode), DeltaSpec.parse(delta), Paging(page))


def bins_of(x, k):
    return [tuple(map(int, b)) for b in zip(*bins.histogram(np.array(x, np.uint64), k), strict=True)]


def test_files_in_hex():
    assert S.compress(np.zeros(0, np.uint32)).hex() == "70636f2102000300"
    assert S.compress(np.array([77], np.uint64)).hex() == "70636f2102400302000000100100004d0000000000000000"
    x = np.full(5, 7, np.uint32)
    assert S.compress(x, config(mode="classic", delta="none")).hex() == "70636f21024201030104000000100038000000000000"


def test_histograms():
    assert bins_of(range(1, 10), 2) == [(3, 1, 3), (2, 4, 5), (2, 6, 7), (2, 8, 9)]
    assert bins_of([0, 0, 0, 1, 2, 2, 2, 2], 3) == [(3, 0, 0), (1, 1, 1), (4, 2, 2)]
    assert bins_of([0, 0, 1, 2, 2, 2, 2, 2], 3) == [(2, 0, 0), (1, 1, 1), (5, 2, 2)]
    assert bins_of([3, *[5] * 97, 7, 7], 2) == [(1, 3, 3), (97, 5, 5), (2, 7, 7)]
    assert bins_of([3, *[5] * 97, 7, 7], 1) == [(98, 3, 5), (2, 7, 7)]


def test_merging():
    u = lambda *a: np.array(a, np.uint32)
    assert bins.merge(np.array([100, 100, 100, 100, 50]), u(1, 33, 49, 65, 75), u(16, 48, 64, 74, 79), 10, 32) == [(0, 0), (1, 2), (3, 4)]
    assert bins.merge(np.array([1000, 1000]), u(0, 200), u(150, 200), 10, 32) == [(0, 0), (1, 1)]


def test_weights():
    for count, total, log, want in (([777, 1], 778, 2, (2, [3, 1])), ([2, 3, 6, 5, 1], 17, 3, (3, [1, 1, 3, 2, 1])), ([77, 100], 177, 4, (4, [7, 9])), ([77, 77], 154, 4, (1, [1, 1]))):
        got = bins.quantize(np.array(count), total, log)
        assert (got[0], got[1].tolist()) == want


def test_entropy_coder_sizes():
    def size(symbols, weights, log):
        table = tans.Table(log, np.array(weights))
        s = np.array([symbols])
        return tans.encode(table, s, np.ones(s.shape, bool))[1].sum()

    assert size([0, 1, 2] * 200, [3, 3, 2], 3) <= 125 * 8
    assert size(([0] * 7 + [1]) * 100, [7, 1], 3) <= 55 * 8


def test_samples():
    assert [sample.size(n) for n in (9, 10, 100, 1_000_010)] == [0, 10, 12, 25_010]
    x = -np.arange(150.0)
    got = sample.choose(x, x != 0)
    assert len(got) == 13 and sorted(got)[:3] == [-147, -142, -119]
    assert sample.delta_positions(8, 2, 2).tolist() == [0, 1, 3, 4, 6, 7]


def test_gcds_and_bases():
    for triple, want in (([1, 5, 9], 4), ([8, 5, 2], 3), ([3, 3, 3], 0), ([5, 0, 10], 5)):
        assert choose.triple_gcds(np.array(triple, np.uint32)).tolist() == [want]
    base = lambda *x: (choose.candidate_base(np.array(x, np.uint32)) or (None,))[0]
    assert base(0, 4, 8) is None
    assert base(0, 4, 8, 10, 14, 18, 20, 24, 28) == 4
    assert base(1, 11, 21, 31, 41, 51, 61, 71, 82) == 10
    assert base(1, 11, 22, 31, 41, 51, 61, 71, 82) is None


def test_deltas():
    mid = np.uint64(1 << 63)
    d = np.array([0, 10, 0], np.uint64) + mid
    assert deltas.decode(np.array([1, 2], np.uint64), d, 5, Delta("consecutive", 2)).tolist() == [1, 3, 5, 17, 29]
    x = np.array([2, 2, 1, 2**32 - 1, 0], np.uint32)
    for order in range(1, 8):
        state, kept = deltas.encode(x, Delta("consecutive", order))
        assert deltas.decode(state, kept, 5, Delta("consecutive", order)).tolist() == x.tolist()
    with pytest.raises(CorruptionError):
        deltas.decode(np.zeros(1, np.uint32), np.zeros(4, np.uint32), 5, Delta("lookback", window_log=2), np.array([5, 1, 1, 1]))


def test_ords_and_splits():
    t = N.TYPES["i32"]
    assert N.to_latent(np.array([-(2**31), -1, 0, 2**31 - 1], np.int32), t).tolist() == [0, 2**31 - 1, 2**31, 2**32 - 1]
    first, second = modes.split(np.array([8, 1, 5], np.uint32), N.TYPES["u32"], Mode("int_mult", 4))
    assert first.tolist() == [2, 0, 1] and second.tolist() == [0, 1, 1]
    x = np.array([-0.0, 0.0, 1, -1, 2.0**53, 2.0**53 + 2, np.inf, -3e300])
    r = N.int_float_rank(x, N.TYPES["f64"])
    assert same(x, N.int_float_unrank(r, N.TYPES["f64"])) and int(r[1] - r[0]) == 1
    assert N.round_away(np.array([2.5, -2.5, 0.5, 0.49999999999999994])).tolist() == [3, -3, 1, 0]


def test_mode_choices():
    mode = lambda x: choose.auto_mode(x, N.type_of(x))
    assert mode(np.arange(1000) * 1.5) == Mode("float_mult", 1.5)
    bits = np.float64(1.0).view(np.int64) + (np.arange(1000, dtype=np.int64) << 20)
    assert mode(bits.view(np.float64)) == Mode("float_quant", k=20)
    assert mode((RNG.integers(-1000, 1000, 300) * 8 - 1).astype(np.int32)) == Mode("int_mult", 8)
    x = np.r_[np.arange(300) * 0.01, np.full(300, np.inf)]
    assert mode(x) == Mode("float_mult", 0.01)
    assert len(S.compress(x)) < (9 * 300 + 3 * 300) / 8 + 100


def cases():
    yield "extremes_u64", np.array([0, 2**64 - 1], np.uint64)
    yield "extremes_f64", np.array([-np.finfo(float).max, np.finfo(float).max])
    yield "single", np.array([1.2], np.float32)
    yield "specials", np.array([-np.inf, -65504, -1, -0.0, np.nan, 0, 1, 65504, np.inf], np.float16)
    yield "moderate", np.arange(-5000, 5000, dtype=np.int32)
    yield "sparse", np.r_[np.ones(10_000), 0, 0, 1].astype(np.int32)
    for t in N.TYPES.values():
        if t.is_float:
            top = np.finfo(t.dtype).max
            yield t.name, np.array([top, -top, np.nan, np.inf, -np.inf, 0.0, -0.0, 77.7], t.dtype)
        else:
            info = np.iinfo(t.dtype)
            yield t.name, np.array([0, info.max, info.min, 7, info.max // 3], t.dtype)
    for b in (56, 57, 64):
        yield f"offsets_{b}", np.tile(np.array([0, 1 << (b - 1)], np.uint64), 50)
    yield "islands", np.concatenate([np.r_[RNG.integers(0, 8, 99), RNG.integers(1000, 1008, 1)] for _ in range(20)]).astype(np.int32)
    yield "mod9", (np.arange(100) % 9).astype(np.int32)
    yield "ranges", np.r_[0:1000, 2000:3000].astype(np.int32)
    x = np.arange(2000, dtype=np.float32)
    x[1337] += 1.001
    yield "near_ints", x
    yield "thousands", np.where(np.arange(2000) == 1337, -1, 0) + np.arange(2000) * 1000
    yield "quantized", RNG.normal(size=3000).astype(np.float32).astype(np.float64)
    yield "uniform", RNG.integers(-(2**63), 2**63 - 1, 3000)
    yield "walk", np.cumsum(RNG.integers(-5, 6, 5000))


@pytest.mark.parametrize("delta", ["auto", "none", "consecutive@1", "consecutive@7", "lookback"])
@pytest.mark.parametrize("mode", ["auto", "classic"])
def test_round_trips(mode, delta):
    for name, x in cases():
        for level in (0, 8) if mode == "classic" else (8,):
            data = S.compress(x, config(level, mode, delta))
            assert same(x, S.decompress(data)), name
            assert len(data) <= S.file_guarantee(N.type_of(x), [len(x)]), name


@pytest.mark.parametrize("mode", ["floatmult@100", "floatmult@0.1", "floatquant@13", "floatquant@52"])
def test_forced_float_modes(mode):
    for x in (np.tile([100.1, 299.9, 200.0], 100), RNG.uniform(-1, 1, 300), np.array([np.nan, np.inf, -np.inf, -0.0, 0.0, 1e300])):
        assert same(x, S.decompress(S.compress(x, config(mode=mode))))


def test_pages_decode_in_any_order_and_alone():
    x = RNG.normal(size=1700)
    for paging in (Paging(600), Paging(exact=(1, 499, 1200)), Paging(1)):
        meta, pages, plan = C.compress(x[: 1700 if paging.most != 1 else 3], config=ChunkConfig(paging=paging, delta=DeltaSpec("consecutive", 2)))
        got = C.read_meta(Reader(meta), N.TYPES["f64"])
        ends = np.cumsum(plan.page_n)
        for i in reversed(range(len(pages))):
            (y,), _ = C.read_pages(got, [pages[i]], [plan.page_n[i]])
            assert same(x[ends[i] - plan.page_n[i] : ends[i]], y)
        assert len(meta) == -(-C.meta_bits(plan.meta) // 8)


def test_every_truncation_lacks_data():
    for x in (np.r_[np.zeros(50), np.full(50, 1000)].astype(np.int32), (2**64 // 1000) * np.arange(100, dtype=np.uint64)):
        data = S.compress(x, config(delta="none"))
        for n in range(len(data)):
            with pytest.raises(InsufficientDataError):
                S.decompress(data[:n])


def test_corruption_raises_or_decodes_but_never_crashes():
    data = bytearray(S.compress(np.cumsum(RNG.integers(-5, 6, 2000)), config(delta="lookback")))
    for _ in range(150):
        bad = bytearray(data)
        bad[RNG.integers(0, len(bad))] ^= 1 << RNG.integers(0, 8)
        try:
            S.decompress(bytes(bad))
        except CodecError:
            pass


def test_guarantee_holds_for_bad_choices():
    x = RNG.uniform(-1, 1, 300)
    meta, pages, plan = C.compress(x, config=config(mode="floatmult@0.1", delta="consecutive@5", page=10))
    assert len(meta) + sum(map(len, pages)) <= C.guarantee(N.TYPES["f64"], 300) + 30 and plan.meta.mode.kind == "classic"


def test_arguments():
    x = np.arange(10)
    for bad in (config(13), config(delta="consecutive@8"), config(mode="intmult@0"), config(mode="floatmult@2")):
        with pytest.raises(InvalidArgumentError):
            S.compress(x, bad)
    for text in ("consecutive", "3", "lookback@1", ""):
        with pytest.raises(InvalidArgumentError):
            DeltaSpec.parse(text)
    with pytest.raises(InvalidArgumentError):
        Paging(exact=(3, 4)).counts(8)
    assert str(ModeSpec.parse("IntMult@8")) == "intmult@8" and str(DeltaSpec.parse("consecutive@3")) == "consecutive@3"


def test_partial_decode_and_many_chunks():
    x = RNG.normal(size=300)
    data = S.compress(x, config(page=100))
    out = np.zeros(3)
    assert S.decompress_into(data, out) == (3, False) and same(x[:3], out)
    out = np.zeros(600)
    assert S.decompress_into(data, out) == (300, True) and same(x, out[:300])
    two = S.header() + S.write_chunk(np.array([1, 2, 3])) + S.write_chunk(np.array([11, 12, 13])) + S.FOOTER
    assert S.decompress(two).tolist() == [1, 2, 3, 11, 12, 13]
    assert S.decompress(S.compress(x[:0])) is None


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 64), st.integers(0, 2**64 - 1)), max_size=200))
def test_packing(fields):
    lengths = np.array([n for n, _ in fields], np.int64)
    values = np.array([v & ((1 << n) - 1) for n, v in fields], np.uint64)
    r = Reader(pack(values, lengths).tobytes())
    assert [r.bits(n) for n in lengths.tolist()] == values.tolist()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(width=64), max_size=400), st.sampled_from(["auto", "classic", "floatmult@0.1", "floatquant@30"]), st.integers(1, 500))
def test_any_floats(values, mode, page):
    x = np.array(values, np.float64)
    if len(x):
        meta, pages, plan = C.compress(x, config=config(mode=mode, page=page))
        y, _ = C.read_pages(C.read_meta(Reader(meta), N.TYPES["f64"]), pages, plan.page_n)
        assert same(x, np.concatenate(y))


@pytest.mark.parametrize(
    "x, config, want",
    [
        (np.arange(-3, 60) * 7 % 50, ChunkConfig(mode=ModeSpec("classic"), delta=DeltaSpec("none")), {"primary": ("primary", "", str)}),
        (np.array([5, 7, 4, 4]), ChunkConfig(mode=ModeSpec("classic"), delta=DeltaSpec("consecutive", 1)), {"primary": ("delta", "", ["2", "-3", "0"])}),
        (np.array([1.0, np.nextafter(1.0, 2)]), ChunkConfig(mode=ModeSpec("classic"), delta=DeltaSpec("consecutive", 1)), {"primary": ("delta", " ULPs", ["1"])}),
        (np.array([-10, 0, 25, 31]), ChunkConfig(mode=ModeSpec("int_mult", 8), delta=DeltaSpec("none")), {"primary": ("multiplier [x8]", "x", ["-2", "0", "3", "3"]), "secondary": ("adjustment", "", ["6", "0", "1", "7"])}),
        (np.array([0.5, -1.0, 2.0]), ChunkConfig(mode=ModeSpec("float_mult", 0.5), delta=DeltaSpec("none")), {"primary": ("multiplier [x0.5]", "x", ["1.0", "-2.0", "4.0"]), "secondary": ("adjustment", " ULPs", ["0", "0", "0"])}),
        (np.tile([1.0, -1.0, 2.5], 200), ChunkConfig(mode=ModeSpec("float_quant", 20), delta=DeltaSpec("none")), {"primary": ("quantized", "", ["1.0", "-1.0000000002328304", "2.5"]), "secondary": ("magnitude adjustment", " ULPs", ["0", "0", "0"])}),
        (np.arange(40) % 9, ChunkConfig(mode=ModeSpec("classic"), delta=DeltaSpec("lookback")), {"delta": ("lookback", "", None), "primary": ("delta", "", None)}),
    ],
)
def test_descriptions(x, config, want):
    from tessera.kernel import describe

    plan = C.plan(x, N.type_of(x), config)
    got = describe.describe(plan.meta)
    assert {v: (d.name, d.unit) for v, d in got.items()} == {v: w[:2] for v, w in want.items()}
    for v, (_, _, texts) in want.items():
        if texts is str:
            assert got[v].texts(plan.stored[v][0]) == [str(i) for i in x.tolist()]
        elif texts:
            assert got[v].texts(plan.stored[v][0])[: len(texts)] == texts
