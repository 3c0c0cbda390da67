"""Near-dedup by MinHash: one-permutation hashing with optimal densification.

A document is the set of its distinct word shingles (64-bit hashes). One hash
function deals the set over BANDS * ROWS bins and the least value of each bin is
kept; an empty bin takes the value of the first non-empty bin in a fixed random
order of its own. Bands of ROWS bins are bucket keys: at similarity 0.8 a pair
misses all 32 bands with probability 3e-6.

Documents with the same set are one class, so that copies never meet in a
bucket. Candidates are stars, a bounded number for each document: first every
document meets the hub (smallest id) that it shares the most buckets with; then,
LEVELS times, a document outside of the largest component of some of its buckets
meets the MEET hubs of such components that it shares the most buckets with. This
merges most groups with few pairs, but decides nothing: documents of buckets that
still hold several components are settled in blocks by their full sets, so no link
inside a bucket is lost; a block tells only the links that join components, so that
what is written grows with the documents and not with their pairs. Star pairs pass a length filter and, for
sets larger than the sketch, an estimate from 8-bit bins that is five standard
deviations below the threshold; all pairs are confirmed on the full sets.
"""
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, join_groups
from . import words
from .components import components
from .words import mix

BANDS, ROWS = 32, 5
#: Rounds of stars after the first, and hubs that a document meets in each. More of
#: them only save work: what they leave open is settled exactly.
LEVELS, MEET = 1, 3
#: Fixed random masks that choose the hubs of a component; 0 chooses the smallest id.
MASKS = (0, 0x2545F4914F6CDD1D, 0x5851F42D4C957F2D)
#: Ids are broadcast up to this number (16 MB).
FEW_IDS = 1 << 20
#: Pairs are broadcast, with their sketches, up to this number (16 MB).
FEW_PAIRS = 1 << 16
#: Documents and shingles (8 MB) of a block of those that are compared in one job.
BLOCK, BLOCK_SHINGLES = 1 << 10, 1 << 20
#: Bytes of text whose words are hashed at once.
TEXT_BYTES = 1 << 22
_MULT = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each whole text the sorted distinct hashes of its word shingles: A-Z in
    lower case, words between ASCII white space; with fewer words than width the
    whole sequence is one shingle, without words there is none."""
    for _, some in words.parts(texts, TEXT_BYTES):
        h, n = words.counted(some)
        full = np.full(max(0, len(h) - width + 1), width, np.uint64)
        for j in range(width):
            full = full * _MULT + h[j : len(h) - width + 1 + j]
        full = mix(full)
        at = 0
        for k in n.tolist():
            if k >= width:
                yield np.unique(full[at : at + k - width + 1])
            elif k:
                one = np.uint64(k)
                with np.errstate(over="ignore"):
                    for x in h[at : at + k]:
                        one = one * _MULT + x
                yield mix(np.array([one]))
            else:
                yield np.empty(0, np.uint64)
            at += k


class Sketcher:
    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 11):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        rng = np.random.default_rng(seed)
        #: rank[j, i]: when bin j, if empty, asks bin i.
        self.rank = np.argsort(rng.random((self.bins, self.bins)), axis=1).argsort(axis=1).astype(np.int16)
        self.odd = rng.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)

    def signature(self, sets: np.ndarray) -> np.ndarray:
        at = ((sets >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        full, first = np.unique(at, return_index=True)
        full = full.astype(np.int64)
        sig = np.zeros(self.bins, np.uint64)
        sig[full] = sets[first]
        if len(full) < self.bins:
            empty = np.setdiff1d(np.arange(self.bins), full, assume_unique=True)
            sig[empty] = sig[full[self.rank[empty][:, full].argmin(axis=1)]]
        return sig

    def keys(self, sig: np.ndarray) -> np.ndarray:
        mixed = mix(sig.reshape(self.bands, self.rows) * self.odd).sum(axis=1, dtype=np.uint64)
        return mix(mixed + np.arange(self.bands, dtype=np.uint64) * _MULT).view(np.int64)


def sketches(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_key, keys, low) of docs (doc_id, text): the set's
    digest, its bucket keys, and 8 bits of each bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Sketcher(bands, rows)
        for batch in batches:
            n, key, keys, low = [], [], [], []
            for s in shingle_sets(batch.column("text"), width):
                n.append(len(s))
                if len(s):
                    sig = maker.signature(s)
                    key.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append(maker.keys(sig))
                    low.append((mix(sig) & np.uint64(255)).astype(np.uint8).tobytes())
                else:
                    key.append(None)
                    keys.append(None)
                    low.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())], ["doc_id", "n_shingles", "set_key", "keys", "low"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, keys array<long>, low binary")


def _few(df: DataFrame, most: int = FEW_IDS) -> DataFrame:
    """A written table, to be broadcast if it is small."""
    return F.broadcast(df) if df.n_rows <= most else df


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, set) for a written table of (doc_id, set_key), from the rows that
    have both. The texts stay where they are if the ids are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.tobytes() for x in shingle_sets(batch.column("text"), width)]
            own = [xxhash.xxh3_128_digest(x) == key for x, key in zip(sets, batch.column("set_key").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["doc_id", "set"]).filter(pa.array(own, pa.bool_()))

    asked = docs.join(_few(ids), "doc_id").select("doc_id", "text", "set_key")
    return asked.mapInArrow(run, "doc_id long, set binary").dropDuplicates(["doc_id"])


def _likely(pairs: DataFrame, nodes: DataFrame, percent: int, bins: int) -> DataFrame:
    """Pairs (a, b) that can reach the threshold by length and, for sets of at
    least as many shingles as bins, by 8-bit bins. (The bins of smaller sets
    depend on each other, so they tell too little.)"""
    p = percent / 100
    least = bins * max(0.0, p - 5 * (p * (1 - p) / bins) ** 0.5)
    a = nodes.select(F.col("doc_id").alias("a"), F.col("n_shingles").alias("na"), F.col("low").alias("la"))
    b = nodes.select(F.col("doc_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("low").alias("lb"))
    first = _few(pairs, FEW_PAIRS).join(a, "a")
    first = F.broadcast(first) if pairs.n_rows <= FEW_PAIRS else first
    near = first.join(b, "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("la", "lb"))
                small = batch.column("n").to_numpy() < bins
                yield batch.select(["a", "b"]).filter(pa.array(small | ((x == y).sum(axis=1) >= least)))

    return near.select("a", "b", F.least("na", "nb").alias("n"), "la", "lb").mapInArrow(run, "a long, b long").distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, that reach the threshold on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    few = _few(pairs)
    ids = F.broadcast(pairs.select("b").distinct()) if pairs.n_rows <= FEW_IDS else pairs.select("b").distinct()
    # Where the pairs are few, only sets that are asked for are shuffled.
    left, right = sets.toDF("a", "sa").join(few, "a"), sets.toDF("b", "sb").join(ids, "b", "left_semi")
    return left.join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def near_dedup(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs.

    component_id is the smallest doc_id reachable over links of at least
    ``percent`` per cent Jaccard similarity. Null and empty texts have no
    shingles and are linked with nothing. Rows with a null doc_id take no part:
    their component_id is null and they are kept. Rows that repeat entirely are
    classed alike. Rows that share a doc_id but not a text are one document to
    their copies, and their links are those of the set with the least digest.
    Other columns aren't looked at; an empty table gives no rows."""
    scratch = Scratch(docs.sparkSession, "near-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    marks = scratch.keep(sketches(docs, width, bands, rows), "sketches")
    part = marks.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "n_shingles", "keys", "low")).alias("first")
    classes = scratch.keep(part.groupBy("set_key").agg(first, F.count(F.lit(1)).alias("n_rows")).select("set_key", "n_rows", "first.*"), "classes")
    again = scratch.keep(classes.groupBy("doc_id").agg(F.min("set_key").alias("own"), F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "own"), "again")
    nodes = classes if not again.n_rows else classes.join(_few(again), "doc_id", "left").where("own IS NULL OR own = set_key").drop("own")

    # Most buckets hold one document; these are gone before hubs are looked for.
    slim = nodes.select("doc_id", F.explode("keys").alias("bucket"))
    multi = slim.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("hub")).where("n_rows > 1")
    multi = scratch.keep(multi, "buckets")
    members = scratch.keep(join_groups(slim, multi, "bucket", "n_rows").select("bucket", "doc_id", "hub"), "members")
    ids = scratch.keep(members.select("doc_id").distinct().join(nodes.select("doc_id", "set_key"), "doc_id"), "ids")
    sets = scratch.keep(_sets(docs, ids, width), "sets")

    links, known = None, None
    for level in range(LEVELS + 1):
        if level:
            opened = _opened(scratch, members, known, MASKS[level % len(MASKS)])
            rest = join_groups(_labelled(members, known), opened, "bucket", "n_rows", F.col("label") != F.col("main"))
        else:
            rest = members.where("doc_id <> hub")
        stars = scratch.keep(_stars(rest, MEET if level else 1), "stars")
        if not stars.n_rows:
            break
        pairs = scratch.keep(_likely(stars, nodes, percent, bands * rows), "pairs")
        found = scratch.keep(_confirmed(pairs, sets, percent), "links")
        links = found if links is None else scratch.keep(links.unionByName(found), "links")
        if known is None or found.n_rows:
            known = components(scratch, links)
        scratch.release()
    if known is not None:
        # What is left in open buckets is settled on the full sets.
        found = _open_links(scratch, members, nodes, sets, known, percent)
        if found is not None and found.n_rows:
            known = components(scratch, links.unionByName(found))
        scratch.release()

    top = (members.select(F.col("doc_id"), F.col("hub").alias("label")).limit(0) if known is None else known.toDF("doc_id", "label"))
    classed = classes.select("set_key", "n_rows", "doc_id").join(top, "doc_id", "left").select("set_key", "n_rows", F.coalesce("label", "doc_id").alias("component_id"))
    inside = join_groups(part.select("doc_id", "n_shingles", "set_key"), scratch.keep(classed, "classed"), "set_key", "n_rows").select("doc_id", "n_shingles", "component_id")
    outside = marks.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = inside.unionByName(outside)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _stars(rest: DataFrame, meet: int) -> DataFrame:
    """Pairs (a, b) of a document and the hubs, at most ``meet``, that it shares
    the most buckets with. A document has one hub in a bucket, so its list is
    bounded by the number of bands."""
    each = rest.groupBy("doc_id", "hub").agg(F.count(F.lit(1)).alias("n"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "hub"))), 1, meet)
    return each.groupBy("doc_id").agg(best.alias("hubs")).select(F.col("doc_id").alias("a"), F.explode("hubs.hub").alias("b"))


def _labelled(members: DataFrame, known: DataFrame) -> DataFrame:
    """members (bucket, doc_id) with the label of each document's component."""
    label = _few(known).withColumnsRenamed({"node": "doc_id"})
    return members.join(label, "doc_id", "left").select("bucket", "doc_id", F.coalesce("label", "doc_id").alias("label"))


def _opened(scratch: Scratch, members: DataFrame, known: DataFrame, mask: int) -> DataFrame:
    """(bucket, n_rows, main, hub): the buckets that hold several components, the
    label of the largest and its hub. Partial sums by task come before the shuffles."""
    hub = F.min(F.col("doc_id").bitwiseXOR(F.lit(mask))).bitwiseXOR(F.lit(mask)).alias("hub")
    parts = _labelled(members, known).groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"), hub)
    main = F.max(F.struct("n", "label", "hub")).alias("main")
    opened = parts.groupBy("bucket").agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("parts"), main).where("parts > 1")
    return scratch.keep(opened.select("bucket", "n_rows", F.col("main.label").alias("main"), F.col("main.hub").alias("hub")), "open")


def _open_links(scratch: Scratch, members: DataFrame, nodes: DataFrame, sets: DataFrame, known: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) that join the components of open buckets: fewer for a job than
    it has documents, however many pairs of them match.

    Documents that share open buckets, directly or over others, are a family. Of a
    family, those of one class of lengths meet those of the same and of the next
    class, all that can reach the threshold. More than BLOCK documents, or
    BLOCK_SHINGLES shingles, are cut into blocks, and each two blocks are a job."""
    opened = _opened(scratch, members, known, 0)
    if not opened.n_rows:
        return None
    own = scratch.keep(join_groups(_labelled(members, known), opened, "bucket", "n_rows"), "own")
    least = own.groupBy("bucket").agg(F.min("doc_id").alias("least"))
    family = components(scratch, own.join(least, "bucket").where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b")).distinct())
    # Of sizes n <= m at the threshold, m is in the class of n or in the next one.
    step = F.floor(F.log(F.col("n_shingles")) / float(np.log(100 / percent) + 1e-6)).cast("int")
    docs = family.select(F.col("node").alias("doc_id"), F.col("label").alias("family")).join(own.select("doc_id", "label").distinct(), "doc_id").join(nodes.select("doc_id", "n_shingles"), "doc_id")
    each = docs.withColumn("step", step).withColumn("class", F.explode(F.array(F.col("step"), F.col("step") - 1))).withColumn("guest", F.col("class") != F.col("step"))
    each = scratch.keep(each.select("doc_id", "label", "n_shingles", "family", "class", "guest"), "families")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    # Where all have one label, or all are guests, nothing is open.
    groups = each.groupBy("family", "class").agg(blocks, F.min("guest").alias("guests"), (F.min("label") == F.max("label")).alias("one")).where("NOT guests AND NOT one").select("family", "class", "blocks")
    dealt = each.join(groups, ["family", "class"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    dealt = scratch.keep(dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))), "dealt")
    if not dealt.n_rows:
        return None
    jobs = dealt.join(sets, "doc_id").select("family", "class", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", "doc_id", "label", "guest", "set")

    def run(table: pa.Table) -> pa.Table:
        return _job_links(table, percent)

    return scratch.keep(jobs.groupBy("family", "class", "one", "two").applyInArrow(run, "a long, b long"), "links")


def _job_links(table: pa.Table, percent: int) -> pa.Table:
    """Links (a, b) that join the components of a job's documents, each confirmed on
    the full sets.

    Shingles are ordered by rarity in the job. A pair that reaches the threshold has
    its rarest common shingle within the first n - ceil(p n) + 1 of the larger set
    and the first m - ceil(2 p m / (1 + p)) + 1 of the smaller one."""
    ids, labels, block, guest = (table.column(c).to_numpy() for c in ("doc_id", "label", "block", "guest"))
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("set")]
    apart = table.column("one")[0].as_py() != table.column("two")[0].as_py()
    n = np.array([len(x) for x in sets], np.int64)
    start = np.cumsum(n) - n
    _, sh, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(sets)), n)
    by = np.lexsort((sh, times[sh], doc))
    sh, at = sh[by], np.arange(len(doc)) - start[doc]
    # A shingle of one document only can't be shared.
    keep = (at < (n - -(-percent * n // 100) + 1)[doc]) & (times[sh] > 1)
    sh, doc, at = sh[keep], doc[keep], at[keep]
    by = np.lexsort((doc, n[doc], sh))
    sh, doc, at = sh[by], doc[by], at[by]
    first, rest, size = at < (n - -(-2 * percent * n // (100 + percent)) + 1)[doc], n[doc] - at, n[doc]
    _, root = np.unique(labels, return_inverse=True)
    links: list[tuple[int, int]] = []
    # A list is sorted by size, so what is too long for a document stays so further on.
    x, step = np.arange(max(0, len(sh) - 1)), 1
    while len(x):
        y = x + step
        ok = (sh[y] == sh[x]) & (percent * size[y] <= 100 * size[x])
        x, y = x[ok], y[ok]
        a, b = doc[x], doc[y]
        near = (first[x] | (size[x] == size[y]) & first[y]) & ((100 + percent) * np.minimum(rest[x], rest[y]) >= percent * (size[x] + size[y]))
        near &= (root[a] != root[b]) & ~(guest[a] & guest[b]) & ((block[a] != block[b]) | (not apart))
        for i, j in np.unique(np.sort(np.stack([a[near], b[near]], axis=1), axis=1), axis=0).tolist():
            if root[i] != root[j]:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    links.append((int(ids[i]), int(ids[j])))
                    root[root == root[j]] = root[i]
        step += 1
        x = x[x + step < len(sh)]
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that stay, one document of each group, with all their columns."""
    gone = near_dedup(docs, width, percent).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * n >= 80 * (na + nb - n)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, least(a, min(b)) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(c.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON s.doc_id = c.a
"""
