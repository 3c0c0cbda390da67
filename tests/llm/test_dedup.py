"""Exact, near and line dedup against brute force, and their edge cases."""
import collections
import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import components, exact_dedup, line_dedup, near_dedup
from tessera.runtime import Scratch, release


def words_of(text):
    return (text or "").encode().lower().split()


def shingle_set(text, width):
    w = words_of(text)
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def corpus(n=120, seed=3):
    """Groups of near copies with few and many changes, and unrelated texts."""
    rng, out = random.Random(seed), []
    vocab = [f"w{i}" for i in range(400)]
    for _ in range(n):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 8, 40, 120]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            out.append((len(out), " ".join(copy)))
    return out


def test_exact_index_persists(spark):
    scratch = Scratch(spark, "t")
    a = spark.createDataFrame([(1, "x"), (5, "x"), (2, "y"), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_dedup(a, exact_dedup.DigestIndex(spark, scratch.path("i"), 4)).collect()}
    assert got == {1: (5, 2, False), 5: (5, 2, True), 2: (2, 1, True), 3: (4, 2, False), 4: (4, 2, True)}
    b = spark.createDataFrame([(7, "y"), (8, "z")], "doc_id long, text string")
    again = exact_dedup.DigestIndex(spark, scratch.path("i"), 4)
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in exact_dedup.exact_dedup(b, again).collect()}
    assert got == {7: (2, False), 8: (8, True)}
    assert again.rows().count() == 4
    # The same batch once more changes nothing.
    assert {r["doc_id"]: r["kept"] for r in exact_dedup.exact_dedup(b, again).collect()} == {7: False, 8: True}
    assert again.rows().count() == 4


def test_exact_oddities(odd):
    kept = exact_dedup.drop_copies(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert len(ids) == len(set(ids)) and {2, 4, None} <= set(ids) and not {1, 3} & set(ids)


def test_dropping_copies_does_not_move_texts(spark, odd):
    rows = [(i, f"text {i // 2}", i) for i in range(100)] + [(7, "text 3", 9), (7, "text 3", 9), (None, "text 3", 1), (None, "alone", 2), (None, "alone", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __gone int")
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted([(str(i), f"text {i // 2}") for i in range(1, 100, 2)] + [("None", "alone")])
    plain = exact_dedup.drop_copies(df.where("doc_id < 100").dropDuplicates(["doc_id"]))
    assert "ShuffleExchange" not in plain._jdf.queryExecution().executedPlan().toString().replace("AdaptiveSparkPlan", "")


def test_hot_keys(spark):
    rows = [(i, "same" if i % 2 else f"t{i}") for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.exact_dedup(df, exact_dedup.fresh_index(spark))
    assert got.count() == 6000 and got.where("kept").count() == 3001 and got.where("group_size = 3000").count() == 3000


@pytest.mark.parametrize("width", [2, 5])
def test_near_dedup_finds_all_components(spark, width):
    docs = corpus()
    sets = {i: shingle_set(t, width) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(df, width).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def test_a_chain_in_one_bucket_is_one_component(spark):
    """Copies that are each near the base but not near each other."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(200)]
    docs = [(1000, " ".join(base))]
    for i in range(40):
        copy = list(base)
        for j in rng.sample(range(0, 200, 3), 9):
            copy[j] = f"c{i}_{j}"
        docs.append((i, " ".join(copy)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = near_dedup.near_dedup(df, 2).collect()
    near = sum(100 * len(shingle_set(a[1], 2) & shingle_set(docs[0][1], 2)) >= 80 * len(shingle_set(a[1], 2) | shingle_set(docs[0][1], 2)) for a in docs)
    assert near == 41 and {r["component_id"] for r in got} == {0}


def test_pairs_inside_a_crowded_bucket_are_found(spark):
    """Texts that share a template at similarity 0.79, among them pairs of near copies."""
    rng = random.Random(6)
    base, texts = [f"b{i}" for i in range(200)], []
    for i in range(600):
        own = [f"o{i}_{j}" for j in range(27)]
        texts.append(" ".join(base + own))
        if i % 50 == 0:
            texts.append(" ".join(base + own[:2] + [f"p{i}_{j}" for j in range(25)]))
    rng.shuffle(texts)
    sets = [shingle_set(t, 2) for t in texts]
    want = {i: i for i in range(len(texts))}
    for a, b in itertools.combinations(range(len(texts)), 2):
        share = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        assert share >= 0.8 or 0.76 <= share < 0.79
        if share >= 0.8:
            want[b] = a
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df, 2).collect()}
    assert got == want and len(set(want.values())) == 600


@pytest.mark.parametrize("n, pairs", [(302, [(150, 151)]), (2000, [(3, 900), (700, 1200), (1201, 1202), (1990, 1999)])])
def test_links_between_middle_ids_of_a_family_are_found(spark, n, pairs):
    """Documents with 100 common two-word shingles and 17 of their own, which are not
    linked, but for pairs with fewer of their own."""
    common, few = " ".join(f"b{i}" for i in range(101)), {i for p in pairs for i in p}
    docs = [(i, " ".join([common, *(f"o{i}_{j}" for j in range(11 if i in few else 17))])) for i in range(n)]
    want = {i: i for i in range(n)}
    sets = {i: shingle_set(dict(docs)[i], 2) for i in few}
    for a, b in itertools.combinations(sorted(few), 2):
        share = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
        assert share >= 0.8
        want[b] = min(want[a], want[b])
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df, 2).collect()}
    assert got == want


def test_a_crowd_is_settled_without_writing_its_pairs(spark, monkeypatch):
    """Texts of one template with changes that several share: most pairs come near the
    threshold and few reach it."""
    rng, n, wrote = random.Random(12), 400, []
    texts = []
    for _ in range(n):
        copy = [f"b{i}" for i in range(200)]
        for j in rng.sample(range(1, 200, 3), 8):
            copy[j] = f"c{j}_{rng.randrange(2)}"
        texts.append(" ".join(copy))
    sets = [shingle_set(t, 2) for t in texts]
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(range(n), 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    keep = Scratch.keep

    def counted(self, *given, **counts):
        out = keep(self, *given, **counts)
        wrote.append(out.n_rows)
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    monkeypatch.setattr(near_dedup, "BLOCK", 64, raising=False)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df, 2).collect()}
    assert got == {i: root(i) for i in range(n)} and 1 < len(set(got.values())) < n
    # No table has more rows than a document has buckets, for each document.
    assert max(wrote) <= near_dedup.BANDS * n


def test_small_sets_and_repeated_ids(spark):
    """Sets of four and five shingles at similarity 0.8; a doc_id with two texts."""
    rows = [(i, f"a{i // 2} b{i // 2} c{i // 2} d{i // 2} e{i // 2}" + (f" f{i // 2}" if i % 2 else "")) for i in range(200)]
    rows += [(500, "one two three four"), (500, "five six seven eight"), (501, "one two three four"), (502, "five six seven eight")]
    got = collections.defaultdict(set)
    for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect():
        got[r["doc_id"]].add(r["component_id"])
    assert all(got[i] == {i - i % 2} for i in range(200)) and got[500] == got[501] == got[502] == {500}


def test_near_oddities(odd):
    got = near_dedup.near_dedup(odd, 2).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == odd.count()
    assert by_id[2]["component_id"] == 1 and by_id[3]["n_shingles"] == by_id[4]["n_shingles"] == by_id[5]["n_shingles"] == 0
    assert by_id[7]["n_shingles"] == 1 and by_id[6]["n_shingles"] == 4
    assert by_id[None]["component_id"] is None and by_id[None]["kept"]
    left = near_dedup.drop_near_copies(odd)
    assert left.columns == odd.columns and {2} & {r["doc_id"] for r in left.collect()} == set()


def test_densified_signatures_estimate_similarity():
    maker, rng = near_dedup.Sketcher(), np.random.default_rng(2)
    for size in (3, 10, 50, 1000):
        common = rng.integers(0, 2**63, size * 4 // 5, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**63, size - len(common), dtype=np.uint64)])) for _ in range(2))
        want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((maker.signature(a) == maker.signature(b)).mean() - want) < 0.2


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(Scratch(spark, "t"), df).collect()}
    assert got == {i: root(i) for i in parent}


def brute_lines(docs):
    """Rows of (place, words, links, kept), by comparing all lines."""
    lines = [((d is not None, d or 0, i), frozenset(line.encode().lower().split())) for d, t in docs for i, line in enumerate((t or "").split("\n"))]
    out = []
    for x, (place, s) in enumerate(lines):
        match = [p for y, (p, u) in enumerate(lines) if x != y and s and u and 100 * len(s & u) >= 80 * len(s | u)]
        out.append((place, len(s), len(match), not any(p < place for p in match)))
    return collections.Counter(out)


def lines_found(df):
    return collections.Counter(((r["doc_id"] is not None, r["doc_id"] or 0, r["line_no"]), r["n_words"], r["n_links"], r["kept"]) for r in line_dedup.line_classes(df).collect())


@pytest.mark.parametrize("long, whole, block, tile", [(3, 8, 4, 3), (3, 1 << 16, 8, 512), (line_dedup.LONG, line_dedup.WHOLE, line_dedup.BLOCK, line_dedup.TILE)])
def test_lines_match_brute_force(spark, monkeypatch, long, whole, block, tile):
    """With a small LONG most lists are cut into blocks. Some ids are null or repeat."""
    for name, value in (("LONG", long), ("WHOLE", whole), ("BLOCK", block), ("TILE", tile)):
        monkeypatch.setattr(line_dedup, name, value)
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(line_dedup)
    try:
        rng = random.Random(9)
        texts = [t for _, t in corpus(60, seed=8)]
        docs = [(i, "\n".join(rng.sample(texts, rng.randint(1, 6)))) for i in range(50)]
        family = [f"b{j}" for j in range(40)]
        for i in range(24):
            own = [w if rng.random() > 0.05 else f"o{i}_{w}" for w in family]
            docs.append((rng.choice([None, 7, 7, 60 + i]), " ".join(own) + "\n" + rng.choice(texts)))
        docs.append(docs[-1])
        df = spark.createDataFrame(docs, "doc_id long, text string")
        assert lines_found(df) == brute_lines(docs)
    finally:
        cloudpickle.unregister_pickle_by_value(line_dedup)


def test_lists_of_lines_are_met_in_rounds(spark, monkeypatch):
    """Each round deals a part of the keys, and all rounds together find every link."""
    rng, met, keep = random.Random(10), [], Scratch.keep

    def seen(self, part, name, **counts):
        out = keep(self, part, name, **counts)
        met.extend([out.n_rows] * (name == "met"))
        return out

    monkeypatch.setattr(Scratch, "keep", seen)
    texts = [t for _, t in corpus(40, seed=5)]
    docs = [(i, "\n".join(rng.sample(texts, 4))) for i in range(20)]
    assert lines_found(spark.createDataFrame(docs, "doc_id long, text string")) == brute_lines(docs)
    assert len(met) > 1 and max(met) < sum(met)


@pytest.mark.parametrize("group, least, most", [(line_dedup.GROUP, 40, 40), (100, 41, 8 * 40)])
def test_the_sets_of_a_group_travel_once(spark, monkeypatch, group, least, most):
    """Forty near copies are 780 pairs; each set is asked for once in the part of its
    group, or in some of the eight that a large group is dealt to."""
    tables, keep = {}, Scratch.keep

    def seen(self, part, name, **counts):
        tables[name] = out = keep(self, part, name, **counts)
        return out

    monkeypatch.setattr(Scratch, "keep", seen)
    monkeypatch.setattr(line_dedup, "GROUP", group)
    family = [f"w{j}" for j in range(40)]
    docs = [(i, " ".join([*family, f"own{i}"])) for i in range(40)] + [(100 + i, f"alone{i} " + " ".join(family[:3])) for i in range(5)]
    assert lines_found(spark.createDataFrame(docs, "doc_id long, text string")) == brute_lines(docs)
    assert tables["pairs"].n_rows == 780 and least <= tables["asks"].n_rows <= most


def test_repeated_rows_do_not_repeat_sets(spark):
    docs = [(i, f"a b c d e f g h i j{i}\nx{i} y z") for i in range(6)] * 2 + [(9, None)]
    assert lines_found(spark.createDataFrame(docs, "doc_id long, text string")) == brute_lines(docs)


def test_parity_maps_tell_unrelated_lines_apart():
    """Maps never differ in more places than sets do; those of unrelated lines of 95
    words differ in more than a match of them may."""
    rng = random.Random(12)
    lines = [{f"w{rng.randrange(50_000)}" for _ in range(95)} for _ in range(60)]
    lines += [(s - set(rng.sample(sorted(s), 6))) | {f"n{i}"} for i, s in enumerate(lines[:20])]
    flat, sizes, _ = line_dedup.spread(pa.array([" ".join(sorted(s)) for s in lines]), np.full(1 << 10, 200, np.uint8))
    bits = line_dedup.Lines(flat, sizes).bits.view(np.uint64)
    for i, x in enumerate(lines):
        for j, y in enumerate(lines[:i]):
            apart = int(np.bitwise_count(bits[:, i] ^ bits[:, j]).sum())
            assert apart <= len(x ^ y)
            assert (180 * apart <= 20 * (len(x) + len(y))) == (5 * len(x & y) >= 4 * len(x | y))


def test_overlaps_of_packed_lines():
    rng = random.Random(13)
    lines = [" ".join(rng.choice("abcdefghijk") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    left, right = (line_dedup.packed(pa.array(x, pa.string()).cast(pa.binary())) for x in (lines[:200], lines[200:]))
    for got, x, y in zip(zip(*line_dedup.overlaps(left[50:], right[50:]), strict=True), lines[50:200], lines[250:], strict=True):
        assert got == (len(set(x.split())), len(set(y.split())), len(set(x.split()) & set(y.split())))
    own, place = line_dedup._each(np.array([3, 5, 7]), np.array([4, 5, 9]))
    assert own.tolist() == [0, 2, 2] and place.tolist() == [3, 7, 8]


def test_release_drops_plans_at_once(spark):
    """References that Python has given up don't wait for the gateway's thread."""
    for _ in range(5):
        time.sleep(0.3)
        df = spark.range(5)
        reference = df._jdf._target_id
        del df
        release(spark)
        queue = spark.sparkContext._gateway._gateway_client.finalizer_deque
        assert reference not in [x[1] for x in list(queue)]


def test_release_frees_the_last_step(spark):
    """Its shuffle files go without a further query."""
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("shuffle_")
    scratch = Scratch(spark, "release")
    release(spark)
    time.sleep(2)
    before = files()
    scratch.keep(spark.range(1000).repartition(4, "id"), "a")
    assert files() > before
    release(spark)
    end = time.time() + 5
    while files() > before and time.time() < end:
        time.sleep(0.1)
    assert files() <= before


@pytest.mark.parametrize("shared", [None, 1])
def test_near_copies_of_lines_under_one_id_go(spark, shared):
    """Six texts that share a doc_id, and six later near copies of them."""
    texts = [" ".join(f"t{i}w{j}" for j in range(20)) for i in range(6)]
    docs = [(shared, t) for t in texts] + [(100 + i, t + " more") for i, t in enumerate(texts)]
    assert lines_found(spark.createDataFrame(docs, "doc_id long, text string")) == brute_lines(docs)
    assert line_dedup.line_classes(spark.createDataFrame(docs, "doc_id long, text string")).where("NOT kept").count() == 6


def test_a_long_line_has_few_keys():
    flat, sizes, _ = line_dedup.spread(pa.array([" ".join(f"w{i}" for i in range(2000))]), np.full(1 << 10, 200, np.uint8))
    keys, count, first, short = line_dedup.Lines(flat, sizes).keys(np.array([True]), 80)
    assert (len(keys), count[0], first[0], short[0]) == (401, 401, 0, 0)


def test_spread_words_over_lines():
    rng = random.Random(4)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice(["a", "B ", "\n", " ", "é", "\n\n"]) for _ in range(rng.randint(0, 9))) for _ in range(300)]
    _, sizes, n_lines = line_dedup.spread(pa.array(texts), np.zeros(16, np.uint8))
    want = [line_dedup.lines_of(t) for t in texts]
    assert n_lines.tolist() == [len(w) for w in want] and sizes.tolist() == [len(x.split()) for w in want for x in w]


def test_line_oddities(odd, spark):
    got = line_dedup.line_classes(odd)
    assert got.where("n_words = 0 AND NOT kept").count() == 0
    assert got.where("doc_id = 2 AND kept").count() == 0 and got.where("doc_id = 1 AND kept AND class_size = 3 AND n_links = 2").count() == 1
    df = spark.createDataFrame([(1, "keep me\nand this line"), (2, "and this line\nnew"), (3, None)], "doc_id long, text string").selectExpr("*", "1 AS line_no")
    clean = line_dedup.drop_lines(df)
    assert clean.columns == df.columns
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {1: "keep me\nand this line", 2: "new", 3: None}


def test_lists_of_a_frequent_word_go_to_no_jobs(spark, monkeypatch):
    """A word of more than LONG lines that differ otherwise gives few pairs, which are written;
    the sets of its lines aren't dealt to jobs, as those of a group of near copies are."""
    tables, keep = {}, Scratch.keep

    def seen(self, part, name, **counts):
        tables[name] = out = keep(self, part, name, **counts)
        return out

    monkeypatch.setattr(Scratch, "keep", seen)
    rng = random.Random(15)
    docs = [(i, " ".join([f"rare{i % 2}", *rng.sample([f"w{j}" for j in range(14)], 9)])) for i in range(700)]
    assert lines_found(spark.createDataFrame(docs, "doc_id long, text string")) == brute_lines(docs)
    assert tables["pairs"].n_rows and "jobs" not in tables
    family = [f"f{j}" for j in range(40)]
    docs += [(2000 + i, " ".join([*family, f"own{i}"])) for i in range(line_dedup.LONG + 20)]
    assert lines_found(spark.createDataFrame(docs, "doc_id long, text string")) == brute_lines(docs)
    assert tables["jobs"].n_rows and tables["long-rows"].n_rows % (line_dedup.LONG + 20) == 0
