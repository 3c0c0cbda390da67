"""Line dedup by an exact set-similarity join.

A line is the set of its distinct words (A-Z in lower case). Words are ordered
by rarity: by an upper bound of the number of lines they stand in (a counting
array of fixed size, summed over all documents), then by hash. Lines with equal
sets are one class. Two classes with Jaccard similarity of at least 0.8 share a
word within the first size - ceil(0.8 size) + 1 of both, which are a line's keys; a
word that stands in one line only can't be shared and is left out.

* Lists of at most WHOLE lines are met inside the partitions that they are dealt to,
  and pairs leave them that pass the length and positional filters and a bound of
  the symmetric difference by 128-bit parity maps. At the first word that two lines
  share, all words before it differ, so the shorter one must have it early, and only such
  lines are compared with longer ones. Words that may stand in more than
  WHOLE lines are counted before, so that no list over that size is dealt to a task.
* Lists over WHOLE, and those over LONG that give more pairs than CROWD for each of their
  lines, are cut into blocks of about BLOCK lines. Each two blocks are one
  job, which verifies on the full sets and gives sums for each line, so that the
  pairs of a large group are counted but never written. A pair that shares several
  of these lists is counted in the first. A list that is long because its word is
  frequent gives few pairs, and its lines don't carry their sets to jobs.

* A pair that leaves a list is confirmed on the full sets in the part of the smallest
  partner of its second line, so that the sets of a group travel once, not with each pair.
  A group of more than GROUP pairs is dealt to several parts, so that none is large.

Every filter is necessary for a match, so no match is lost.
"""
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import Scratch, join_groups
from . import arrays, words
from .words import mix

SLOTS, SLOT_BLOCK = 1 << 24, 1 << 16
#: Lines of a list whose pairs are written, however many, of one that a task may get whole
#: (2 MB), and of a block of a list that is met by jobs.
LONG, WHOLE, BLOCK = 256, 1 << 16, 2048
#: Pairs for each line that a list of more than LONG lines may give.
CROWD = 32
#: Pairs of lines that are compared at once: their arrays stay in the cache.
COMPARED = 1 << 15
#: Rounds that lists are met in.
ROUNDS = 2
#: Keys that a task holds before it deals them out (8 MB).
DEALT = 1 << 18
#: Lines of a block that are compared at once.
TILE = 512
#: Lines whose places are broadcast to fetch their texts (about 24 MB).
FEW_LINES = 1 << 19
#: Ids and pairs are broadcast up to this number (16 MB).
FEW_IDS = 1 << 20
#: Bytes of text whose words are hashed at once: their arrays, of 8 bytes for each, stay
#: below the size from which the workers' allocator maps each array anew.
TEXT_BYTES = 1 << 17
#: Pairs of a group that are confirmed in one place.
GROUP = 1 << 11
#: Lines whose words are packed at once and pairs that are confirmed at once, at most 2**16,
#: and bytes of these pairs' sets.
PACKED, PAIR_BYTES = 1 << 14, 1 << 20
#: Columns of a matrix of lines and words.
COLUMNS = 1 << 13
#: A line's parity map: of each of 128 values of a word's hash, whether its words are odd in number.
BITS = ("bits", "more_bits")
_LOW = 55
_ODD = np.uint64(0x9E3779B97F4A7C15)


def lines_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split(b"\n")


def rank(counts: np.ndarray) -> np.ndarray:
    """Eight steps for each doubling, 0 for what occurs once."""
    return np.where(counts < 2, 0, np.minimum(255, np.floor(8 * np.log2(np.maximum(counts, 1)))))


def line_counts(docs: DataFrame) -> np.ndarray:
    """For each slot the rank of, at least, the number of lines that have a word
    of that slot: words are counted as often as they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(SLOTS, np.int32)
        for batch in batches:
            for _, some in words.parts(batch.column("text"), TEXT_BYTES):
                h, _ = words.counted(some)
                slot, n = np.unique(h % np.uint64(SLOTS), return_counts=True)
                out[slot.astype(np.int64)] += n.astype(np.int32)
        yield arrays.blocks_of(np.minimum(out, 65535).astype(np.uint16), SLOT_BLOCK)

    return arrays.total(docs.select("text").mapInArrow(run, arrays.SCHEMA), SLOTS, SLOT_BLOCK, rank, np.uint8)


class Lines:
    """The word sets of many lines at once: flat holds the words' sort keys, whose
    order is that of rarity, and sizes the words of each line.

    Lines of similar length are the rows of one matrix, whose rows are sorted,
    freed of repetitions and filled up with PAD."""

    PAD = np.iinfo(np.int64).max

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        n = len(sizes)
        self.n_words = np.zeros(n, np.int32)
        self.key = np.zeros((n, 2), np.uint64)
        self.bits = np.zeros((2, n), np.int64)
        self.grids: list[tuple[np.ndarray, np.ndarray]] = []
        starts = np.cumsum(sizes) - sizes
        width = np.where(sizes > 0, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64), 0)
        for w in np.unique(width[width > 0]).tolist():
            lines = np.flatnonzero(width == w)
            col = np.arange(w)
            own = col < sizes[lines, None]
            grid = np.full(own.shape, self.PAD, np.int64)
            grid[own] = flat[(starts[lines, None] + col)[own]]
            grid.sort(axis=1)
            again = (grid[:, 1:] == grid[:, :-1]) & (grid[:, 1:] != self.PAD)
            if again.any():
                grid[:, 1:][again] = self.PAD
                grid.sort(axis=1)
            own = grid != self.PAD
            self.n_words[lines] = own.sum(axis=1)
            h = mix(grid.view(np.uint64))
            self.key[lines, 0] = np.where(own, h, np.uint64(0)).sum(axis=1, dtype=np.uint64)
            self.key[lines, 1] = np.where(own, mix(h ^ _ODD), np.uint64(0)).sum(axis=1, dtype=np.uint64)
            one = np.where(own, np.uint64(1) << (h >> np.uint64(58)), np.uint64(0))
            half = (h >> np.uint64(57)) & np.uint64(1)
            for k in range(2):
                self.bits[k, lines] = np.bitwise_xor.reduce(np.where(half == k, one, np.uint64(0)), axis=1).view(np.int64)
            self.grids.append((lines, grid))

    def keys(self, wanted: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys of the wanted lines in order, keys of each line, place of each
        line's first key among its words, keys of each line in lists up to WHOLE)."""
        count, first, short = (np.zeros(len(self.n_words), np.int32) for _ in range(3))
        out = []
        for lines, grid in self.grids:
            pick = wanted[lines]
            lines, grid = lines[pick], grid[pick]
            if not len(lines):
                continue
            n = self.n_words[lines].astype(np.int64)
            spare = n + (-percent * n) // 100 + 1
            once = np.minimum((grid < 1 << _LOW).sum(axis=1), spare)
            often = np.clip((grid < int(rank(np.array(WHOLE))) << _LOW).sum(axis=1), once, spare)
            count[lines], first[lines], short[lines] = spare - once, once, often - once
            col = np.arange(grid.shape[1])
            row, at = np.nonzero((col >= once[:, None]) & (col < spare[:, None]))
            out.append((lines[row], grid[row, at]))
        if not out:
            return np.zeros(0, np.int64), count, first, short
        line, key = (np.concatenate(x) for x in zip(*out, strict=True))
        return key[np.argsort(line, kind="stable")], count, first, short


def spread(texts: pa.Array, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sort keys of all words, words of each line, lines of each text)."""
    data, offsets = words.raw(texts)
    h, first = words.hashes(data, offsets)
    key = (ranks[h % np.uint64(len(ranks))].astype(np.int64) << _LOW) | (h >> np.uint64(64 - _LOW)).astype(np.int64)
    breaks = np.flatnonzero(data == 10)
    # A line begins at each text's first byte and after each line feed.
    n_lines = np.diff(np.searchsorted(breaks, offsets)) + 1
    # Of a line, count the words before its end: its line feed or its text's end.
    text = np.repeat(np.arange(len(n_lines)), n_lines)
    last = np.cumsum(n_lines) - 1
    ends = np.empty(len(text), np.int64)
    inner = np.ones(len(text), bool)
    inner[last] = False
    ends[inner], ends[last] = breaks, offsets[1:]
    before = np.searchsorted(first, ends)
    return key, np.diff(np.concatenate([[0], before])), n_lines


def _lines(docs: DataFrame, ranks: np.ndarray, percent: int) -> DataFrame:
    """A row per line. h is a class's number, half of its set's digest; classes
    that share one are told apart when pairs are verified. Keys are given once per
    task for a set that repeats: in sigs, 8 bytes each, first the ``short`` ones in
    lists up to WHOLE, then the ``often`` others."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    names = ["doc_id", "text_key", "line_no", "n_words", "set_key", "h", *BITS, "once", "short", "often", "sigs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at, some in words.parts(batch.column("text"), TEXT_BYTES):
                flat, sizes, n_lines = spread(some, shared.value)
                got, line = Lines(flat, sizes), np.repeat(np.arange(len(n_lines)), n_lines)
                n = got.n_words
                # Sets that no set of another size can match have no keys.
                wanted = n.astype(np.int64) * 100 // percent > n
                for i, k in zip(np.flatnonzero(wanted).tolist(), got.key[wanted, 0].tolist(), strict=True):
                    if k in seen:
                        wanted[i] = False
                    elif len(seen) < 1 << 19:
                        seen.add(k)
                sig, count, once, short = got.keys(wanted, percent)
                key = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(n), [None, pa.py_buffer(got.key.tobytes())]).cast(pa.binary())
                sigs = _binary(sig.tobytes(), 8 * count)
                own = pa.array(line + at)
                spot = np.arange(len(line)) - np.repeat(np.cumsum(n_lines) - n_lines, n_lines)
                columns = [batch.column("doc_id").take(own), batch.column("text_key").take(own), pa.array(spot.astype(np.int32)), pa.array(n), key, pa.array(got.key[:, 0].view(np.int64)), *map(pa.array, got.bits), pa.array(once), pa.array(short), pa.array(count - short), sigs]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text", "text_key").mapInArrow(run, "doc_id long, text_key long, line_no int, n_words int, set_key binary, h long, bits long, more_bits long, once int, short int, often int, sigs binary")


def _binary(data: bytes, sizes: np.ndarray) -> pa.BinaryArray:
    """An array of values of these sizes, one after the other in data."""
    offsets = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _bytes(values: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, size of each) of values that are not null."""
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], np.diff(at)


def line_classes(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), n_words, class_doc, class_line, class_size,
    n_links, kept: a row for each line of each row of docs.

    class_doc and class_line name the first line (by doc_id and line_no) with
    the same set of words, class_size counts its lines; n_links counts the other
    lines that match this one. A line is kept unless a line with a smaller place
    (doc_id, line_no) matches it, removed or not. Lines without words match
    nothing and are kept, with null class and no links; a null text is one such
    line. A null doc_id comes before all others. Rows that share a doc_id, with
    the same text or another, have lines of their own, and none of two lines at
    the same place is before the other. Other columns aren't looked at; an empty
    table gives no rows.

    The links of a group of m lines that all differ and all match are m (m - 1) / 2
    comparisons, whatever the method; beyond lists of LONG lines at most CROWD rows
    are written for each line of a list."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("text_key", F.xxhash64("text"))
    lines = scratch.keep(_lines(docs, line_counts(docs), percent), "lines")
    classes = lines.where("n_words > 0").groupBy("set_key", "h").agg(F.min(F.struct("doc_id", "line_no", "text_key")).alias("first"), F.count(F.lit(1)).alias("n_rows"))
    classes = scratch.keep(classes.select("set_key", "h", "n_rows", F.col("first.doc_id").alias("d"), F.col("first.line_no").alias("l"), F.col("first.text_key").alias("text_key")), "classes")
    scratch.release()

    frequent = scratch.keep(_postings(lines).groupBy("sig", "h").agg(*[F.first(c).alias(c) for c in (*BITS, "size_at")]), "frequent")
    more, rows = None, None
    if frequent.n_rows:
        long = scratch.keep(frequent.groupBy("sig").agg(F.count(F.lit(1)).alias("n_list")).where(F.col("n_list") > WHOLE), "long")
        more = frequent.join(_few(long.select("sig"), long.n_rows), "sig", "left_anti").select(*POSTING)
        rows = join_groups(frequent, long, "sig", "n_list").select(*POSTING, "n_list")
    # Each round deals a share of the keys, so that only that share is on disk at once.
    rounds = []
    for k in range(ROUNDS):
        some = _dealt(lines.where("short > 0").select(*POSTED), k)
        some = some if more is None else some.unionByName(_dealt(more, k))
        rounds.append(scratch.keep(_met(some, percent, LONG), "met", long=F.col("sig").isNotNull()))
        scratch.release()
    met = functools.reduce(DataFrame.unionByName, rounds)
    # first, b's smallest partner, is the same in most of a group.
    pairs = met.where("sig IS NULL").select("a", "b").repartition("b").distinct()
    pairs = scratch.keep(pairs.withColumn("first", F.min("a").over(Window.partitionBy("b"))), "pairs")
    if any(r.long for r in rounds):
        own = met.where("sig IS NOT NULL").select("sig", F.col("a").alias("h"), *BITS, "size_at", "n_list")
        rows = own if rows is None else rows.unionByName(own)
    scratch.release()
    places = lines.select("doc_id", "line_no", "n_words", "set_key")
    rows = None if rows is None else scratch.keep(rows, "long-rows")
    if rows is not None:
        own = scratch.keep(rows.groupBy("h").agg(F.sort_array(F.collect_set("sig")).alias("longs")), "hot")
        rows = rows.join(_few(own), "h")
        # These pairs are counted where their long lists are met.
        a, b = _few(own).toDF("a", "la"), _few(own).toDF("b", "lb")
        apart = ~F.coalesce(F.arrays_overlap("la", "lb"), F.lit(False))
        pairs = scratch.keep(pairs.join(a, "a", "left").join(b, "b", "left").where(apart).select("a", "b", "first"), "pairs")

    need = pairs.select(F.col("a").alias("h")).union(pairs.select("b"))
    need = need if rows is None else need.union(rows.select("h"))
    need = scratch.keep(need.distinct(), "need")
    scratch.drop(frequent, *rounds)
    scratch.release()
    sets = _sets(scratch, docs, classes, need)
    scratch.release()
    parts = [scratch.keep(_confirmed(scratch, pairs, sets, percent), "confirmed")]
    scratch.release()
    if rows is not None:
        parts.append(scratch.keep(_jobs(scratch, rows, sets, percent), "jobs"))
    scratch.drop(sets)
    scratch.release()
    found = functools.reduce(DataFrame.unionByName, parts)
    found = scratch.keep(found.groupBy("set_key").agg(F.sum("n_other").alias("n_other"), F.min("other").alias("other")), "found")
    scratch.release()

    first = F.struct(F.col("d").alias("doc_id"), F.col("l").alias("line_no"))
    told = classes.join(_few(found), "set_key", "left").select("set_key", "n_rows", first.alias("first"), F.least(first, "other").alias("earliest"), (F.col("n_rows") - 1 + F.coalesce("n_other", F.lit(0))).alias("n_links"))
    there = join_groups(places.where("n_words > 0"), scratch.keep(told, "told"), "set_key", "n_rows")
    there = there.select("doc_id", "line_no", "n_words", F.col("first.doc_id").alias("class_doc"), F.col("first.line_no").alias("class_line"), F.col("n_rows").alias("class_size"), "n_links", F.struct("doc_id", "line_no").eqNullSafe(F.col("earliest")).alias("kept"))
    null = lambda kind: F.lit(None).cast(kind)
    none = places.where("n_words = 0").select("doc_id", "line_no", "n_words", null("long").alias("class_doc"), null("int").alias("class_line"), null("long").alias("class_size"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))
    return there.unionByName(none)


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _few(df: DataFrame, n_rows: int | None = None) -> DataFrame:
    """A table of known size, to be broadcast if it is small."""
    return F.broadcast(df) if (df.n_rows if n_rows is None else n_rows) <= FEW_IDS else df


POSTED = ("h", *BITS, "n_words", "once", "short", "often", "sigs")
POSTING = ("sig", "h", *BITS, "size_at")


def _posted(batch: pa.RecordBatch, often: bool, k: int | None = None) -> list[np.ndarray]:
    """The columns POSTING of keys in lists of surely at most WHOLE lines, or the rest; all or
    those of round k."""
    h, bits, more, n_words, once, short, rest = (batch.column(c).to_numpy() for c in POSTED[:-1])
    data, sizes = _bytes(batch.column("sigs"))
    count, skip = (rest, short) if often else (short, np.zeros_like(short))
    own = np.repeat(np.arange(len(h)), count)
    at = np.arange(len(own)) - np.repeat(np.cumsum(count, dtype=np.int64) - count, count) + skip[own]
    sig = data.view(np.int64)[(np.cumsum(sizes) - sizes)[own] // 8 + at]
    if k is not None:
        mine = _of_round(sig, k)
        sig, own, at = sig[mine], own[mine], at[mine]
    return [sig, h[own], bits[own], more[own], (n_words[own].astype(np.int64) << 31) + once[own] + at]


def _postings(lines: DataFrame) -> DataFrame:
    """The keys in lists that may have more than WHOLE lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _posted(batch, True)], POSTING)

    return lines.where("often > 0").select(*POSTED).mapInArrow(run, ", ".join(f"{c} long" for c in POSTING))


def _of_round(sig: np.ndarray, k: int) -> np.ndarray:
    """The places of round k. Rounds go by other bits of a key's hash than partitions."""
    return np.flatnonzero((mix(sig.view(np.uint64)) >> np.uint64(32)) % np.uint64(ROUNDS) == k)


def _dealt(keys: DataFrame, k: int) -> DataFrame:
    """(part, rows): the keys of round k of lines, or of postings, by the partition
    that their list is met in. A task packs many into one row: bytes of like places
    stand together, which compresses them."""
    n, whole = _partitions(keys.sparkSession), "sigs" not in keys.columns

    def packs(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        sig, *more = (np.concatenate(c) for c in zip(*held, strict=True))
        part = (mix(sig.view(np.uint64)) % np.uint64(n)).astype(np.int32)
        by = np.lexsort((sig, part))
        rows, part = np.stack([sig[by], *(x[by] for x in more)]), part[by]
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        ends = np.append(first[1:], len(part))
        data = [rows[:, i:j].copy().view(np.uint8).reshape(len(rows), j - i, 8).transpose(0, 2, 1).tobytes() for i, j in zip(first.tolist(), ends.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[first]), pa.array(data, pa.binary())], ["part", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if whole:
                cols = [batch.column(c).to_numpy() for c in POSTING]
                mine = _of_round(cols[0], k)
                held.append([c[mine] for c in cols])
            else:
                held.append(_posted(batch, False, k))
            size += len(held[-1][0])
            if size >= DEALT:
                yield packs(held)
                held, size = [], 0
        if size:
            yield packs(held)

    return keys.mapInArrow(run, "part int, rows binary")


def _met(postings: DataFrame, percent: int, most: int) -> DataFrame:
    """Pairs (a, b) of class numbers under the same key of dealt postings that pass the filters; of
    lists of more than ``most`` lines that give over CROWD pairs a line, the rows (sig, a, bits,
    more_bits, size_at, n_list). No list is longer than WHOLE, so a partition's rows are as many
    as in any shuffle, and the pairs held of one list are bounded."""
    names = ["a", "b", "sig", *BITS, "size_at", "n_list"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for rows in batch.column("rows"):
                rows = np.frombuffer(rows.as_buffer(), np.uint8).reshape(len(POSTING), 8, -1)
                held.append(np.ascontiguousarray(rows.transpose(0, 2, 1)).view(np.int64)[:, :, 0])
        if not held:
            return
        sig, h, bits, more, size_at = (np.concatenate(c) for c in zip(*held, strict=True))
        del held
        by = np.lexsort((h, size_at, sig))
        sig, h, size_at = sig[by], h[by], size_at[by]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (h[1:] != h[:-1])
        by = by[new]
        sig, h, bits, more, size_at = sig[new], h[new], bits[by].view(np.uint64), more[by].view(np.uint64), size_at[new]
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        n_list = np.diff(np.append(first, len(sig)))
        size, at = size_at >> 31, size_at & ((1 << 31) - 1)
        # At the first word that both have, the overlap is at most the rest of a line from there, and
        # (100 + p) * overlap >= p * both: a line can't match one of more words than its reach.
        reach = np.minimum((100 * size - (100 + percent) * at) // percent, (1 << 31) - 1)
        early = np.flatnonzero(reach >= size)
        # A list is sorted by size, so the lines within a line's reach are a range.
        number = np.repeat(np.arange(len(first), dtype=np.int64) << 31, n_list)
        low, high = early + 1, np.searchsorted(number + size, (number + reach)[early], "right")
        ends = np.cumsum(high - low)

        def near(start: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Places of the pairs of these early lines with later ones that pass, in pieces."""
            while start < end:
                to = min(end, max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + COMPARED, "right"))))
                own, y = _each(low[start:to], high[start:to])
                x = early[start:to][own]
                ok = np.flatnonzero(reach[y] >= size[x])
                x, y = x[ok], y[ok]
                # The symmetric difference is at most both (100 - p) / (100 + p).
                apart = np.bitwise_count(bits[x] ^ bits[y]).astype(np.int64) + np.bitwise_count(more[x] ^ more[y])
                ok = (100 + percent) * apart <= (100 - percent) * (size[x] + size[y])
                yield x[ok], y[ok]
                start = to

        def told(out: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            x, y = (h[np.concatenate(c)] for c in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), *[pa.nulls(len(x), pa.int64())] * (len(names) - 2)], names)

        # Runs of lists of at most ``most`` lines, and each longer list.
        long = np.flatnonzero(n_list > most)
        cuts = np.unique(np.concatenate([[0], first[long], first[long] + n_list[long], [len(sig)]]))
        places, crowds = np.searchsorted(early, cuts), set(first[long].tolist())
        out, n = [], 0
        for i, (begin, end) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            own, n_own = [], 0
            for x, y in near(int(places[i]), int(places[i + 1])):
                own.append((x, y))
                n_own += len(x)
                if begin in crowds and n_own > CROWD * (end - begin):
                    whole = slice(begin, end)
                    none, n_lines = pa.nulls(end - begin, pa.int64()), pa.array(np.full(end - begin, end - begin))
                    yield pa.RecordBatch.from_arrays([pa.array(h[whole]), none, *(pa.array(c[whole]) for c in (sig, bits.view(np.int64), more.view(np.int64), size_at)), n_lines], names)
                    own = []
                    break
                if begin not in crowds and n_own > 1 << 18:
                    yield told(own)
                    own, n_own = [], 0
            out += own
            n += sum(len(x) for x, _ in own)
            if n > 1 << 18:
                yield told(out)
                out, n = [], 0
        if n:
            yield told(out)

    return postings.repartitionById(_partitions(postings.sparkSession), "part").select("rows").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _sets(scratch: Scratch, docs: DataFrame, classes: DataFrame, need: DataFrame) -> DataFrame:
    """(h, set_key, n_rows, d, l, words): the packed word hashes of the classes
    needed, out of the text that has the first line of each."""
    wanted = scratch.keep(classes.join(_few(need), "h"), "wanted")
    asked = F.collect_list(F.struct("l", "h", "set_key", "n_rows", "d")).alias("asked")
    by_text = wanted.groupBy(F.col("d").alias("id"), F.col("text_key").alias("key")).agg(asked)
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key"))
    # The texts stay where they are if the places are few; else both are shuffled.
    texts = docs.join(F.broadcast(by_text) if wanted.n_rows <= FEW_LINES else by_text, same).select("text", "asked")
    names = ["h", "set_key", "n_rows", "d", "l"]

    def packs(asked: pa.StructArray, own: list[int], lines: list[bytes]) -> pa.RecordBatch:
        asked = asked.take(pa.array(own, pa.int64()))
        return pa.RecordBatch.from_arrays([*(asked.field(c) for c in names), packed(pa.array(lines, pa.binary()))], [*names, "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column("asked")
            places, n = asked.flatten(), asked.value_lengths().to_pylist()
            line_no = places.field("l").to_pylist()
            own, found, size, at = [], [], 0, 0
            for text, k in zip(batch.column("text"), n, strict=True):
                lines = (text.as_py() or "").encode().split(b"\n")
                for i in range(at, at + k):
                    if line_no[i] < len(lines):
                        own.append(i)
                        found.append(lines[line_no[i]])
                        size += len(found[-1])
                    if size >= TEXT_BYTES or len(found) >= PACKED:
                        yield packs(places, own, found)
                        own, found, size = [], [], 0
                at += k
            if found:
                yield packs(places, own, found)

    sets = scratch.keep(texts.mapInArrow(run, "h long, set_key binary, n_rows long, d long, l int, words binary"), "sets")
    if sets.n_rows == wanted.n_rows:
        return sets
    # Rows repeat, with the same text under the same id.
    return scratch.keep(sets.dropDuplicates(["set_key"]), "sets")


def packed(lines: pa.BinaryArray) -> pa.BinaryArray:
    """Of each line the upper 48 bits of its words' hashes, in order: two given words
    share them with probability 4e-15."""
    h, n = words.counted(lines.cast(pa.string()))
    own = np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(48), n)
    h = np.unique(own | (h >> np.uint64(16)))
    sizes = np.bincount((h >> np.uint64(48)).astype(np.int64), minlength=len(n))
    return _binary(h.view(np.uint8).reshape(-1, 8)[:, :6].tobytes(), 6 * sizes)


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


FOUND = "set_key binary, n_other long, other struct<doc_id: bigint, line_no: int>"


def _told(keys: pa.Array, n: pa.Array, docs: pa.Array, lines: pa.Array) -> pa.RecordBatch:
    other = pa.StructArray.from_arrays([docs, lines], ["doc_id", "line_no"])
    return pa.RecordBatch.from_arrays([keys, n, other], ["set_key", "n_other", "other"])


def overlaps(left: pa.BinaryArray, right: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each left set, of each right one, words that both have) of at most 2**16 pairs of packed sets."""
    flat, sizes = [], []
    for sets in (left, right):
        data, n = _bytes(sets)
        wide = np.zeros((len(data) // 6, 8), np.uint8)
        wide[:, :6] = data.reshape(-1, 6)
        sizes.append(n // 6)
        flat.append(wide.view(np.uint64)[:, 0] | np.repeat(np.arange(len(n), dtype=np.uint64) << np.uint64(48), sizes[-1]))
    both = np.concatenate(flat)
    both.sort()
    pair = both[1:][both[1:] == both[:-1]] >> np.uint64(48)
    return *sizes, np.bincount(pair.astype(np.int64), minlength=len(left))


def _confirmed(scratch: Scratch, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """For each of the pairs (a, b, first) that matches on the full sets, two rows: what
    either class gains by the other. Pairs of one ``first`` go to one part, or to more
    by their b if they are over GROUP. A set goes once to each part that asks for it,
    and a partition's sets and pairs are held, which are as many as in any shuffle."""
    names = ["set_key", "n_rows", "d", "l"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        lone = table.column("b").is_null()
        own = table.filter(lone).drop_columns(["b"]).sort_by("a").combine_chunks()
        asked = table.filter(pc.invert(lone)).select(["a", "b"])
        del table
        h, a, b = own.column("a").to_numpy(), asked.column("a").to_numpy(), asked.column("b").to_numpy()
        # Classes may share a number, so a pair of numbers may stand for several pairs.
        pair, i = _each(np.searchsorted(h, a), np.searchsorted(h, a, "right"))
        again, j = _each(np.searchsorted(h, b[pair]), np.searchsorted(h, b[pair], "right"))
        i = i[again]
        size = pc.binary_length(own.column("words")).to_numpy().astype(np.int64)
        ends = np.cumsum(size[i] + size[j])
        at = 0
        while at < len(i):
            to = max(at + 1, min(at + PACKED, int(np.searchsorted(ends, ends[at] + PAIR_BYTES))))
            x, y = pa.array(i[at:to]), pa.array(j[at:to])
            n, m, same = overlaps(*(own.column("words").take(k).combine_chunks() for k in (x, y)))
            ok = pa.array(100 * same >= percent * (n + m - same))
            x, y = x.filter(ok), y.filter(ok)
            for mine, other in ((x, y), (y, x)):
                yield _told(*(own.column(c).take(k).combine_chunks() for c, k in zip(names, (mine, other, other, other), strict=True)))
            at = to

    n = _partitions(pairs.sparkSession)
    large = scratch.keep(pairs.groupBy("first").agg(F.count(F.lit(1)).alias("n_pairs")).where(F.col("n_pairs") > GROUP), "large-groups")
    split = F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("n_pairs", F.lit(1)) / GROUP))
    pairs = pairs.join(_few(large), "first", "left").select("a", "b", F.pmod(F.xxhash64("first", split), F.lit(n)).cast("int").alias("part"))
    asks = pairs.select(F.col("a").alias("h"), "part").union(pairs.select("b", "part")).distinct()
    asks = scratch.keep(asks, "asks")
    there = sets.join(_few(asks), "h").select("part", F.col("h").alias("a"), *names, "words")
    both = there.unionByName(pairs, allowMissingColumns=True)
    return both.repartitionById(n, "part").select("a", "b", *names, "words").mapInArrow(run, FOUND)


def _each(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, place) of each place of the ranges."""
    n = end - first
    own = np.repeat(np.arange(len(n)), n)
    return own, np.arange(len(own)) - (np.cumsum(n) - n)[own] + first[own]


def _jobs(scratch: Scratch, rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The same for long lists: rows (sig, h, bits, more_bits, size_at, n_list, longs). A list
    has blocks of about BLOCK lines, and each two blocks, or one with itself, are a
    group of bounded size."""
    blocks = F.ceil(F.col("n_list") / BLOCK).cast("int")
    own = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("h", "sig"), F.col("blocks")).cast("int"))
    own = own.select("sig", "h", *BITS, "longs", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    hot = scratch.keep(rows.select("h").distinct(), "hot-sets")
    own = own.join(sets.join(_few(hot), "h", "left_semi"), "h").select("sig", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"), "block", *BITS, "longs", "set_key", "n_rows", "d", "l", "words")

    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_job(table, percent)])

    return own.groupBy("sig", "one", "two").applyInArrow(run, FOUND)


def _job(table: pa.Table, percent: int) -> pa.RecordBatch:
    table = table.sort_by([("d", "ascending"), ("l", "ascending")])
    # A null doc_id is the smallest.
    ids = table.column("d")
    if ids.null_count:
        table = pa.concat_tables([table.filter(ids.is_null()), table.filter(ids.is_valid())])
    table = table.combine_chunks()
    sig, one, two = (table.column(c)[0].as_py() for c in ("sig", "one", "two"))
    block, bits, more, n_rows = (table.column(c).to_numpy() for c in ("block", *BITS, "n_rows"))
    sets = [unpacked(x.as_py()) for x in table.column("words")]
    size = np.array([len(x) for x in sets], np.int64)
    # A pair is counted in the first of the long lists that both stand in.
    earlier = [np.array([x for x in longs if x < sig], np.int64) for longs in table.column("longs").to_pylist()]
    gained, first = np.zeros(len(sets), np.int64), np.full(len(sets), len(sets))
    rows, cols = np.flatnonzero(block == one), np.flatnonzero(block == two)
    for at in range(0, len(rows), TILE):
        i = rows[at : at + TILE]
        for to in range(at if one == two else 0, len(cols), TILE):
            j = cols[to : to + TILE]
            both = size[i][:, None] + size[j]
            ok = 100 * np.minimum(size[i][:, None], size[j]) >= percent * np.maximum(size[i][:, None], size[j])
            apart = sum(np.bitwise_count((x[i][:, None] ^ x[j]).view(np.uint64)).astype(np.int64) for x in (bits, more))
            ok &= (100 + percent) * apart <= (100 - percent) * both
            if one == two:
                ok &= i[:, None] < j
            ok &= _common([earlier[k] for k in i], [earlier[k] for k in j], ok) == 0
            same = _common([sets[k] for k in i], [sets[k] for k in j], ok)
            ok &= 100 * same >= percent * (both - same)
            gained[i] += ok.astype(np.int64) @ n_rows[j]
            gained[j] += ok.T.astype(np.int64) @ n_rows[i]
            # Rows are in the order of places, so the smallest number is the first place.
            for mine, other, hit in ((i, j, ok), (j, i, ok.T)):
                some = hit.any(axis=1)
                first[mine[some]] = np.minimum(first[mine[some]], other[hit[some].argmax(axis=1)])
    some = np.flatnonzero(gained).tolist()
    keys, docs, lines = (table.column(c).to_pylist() for c in ("set_key", "d", "l"))
    n, docs, lines = pa.array(gained[some]), [docs[first[i]] for i in some], [lines[first[i]] for i in some]
    return _told(pa.array([keys[i] for i in some], pa.binary()), n, pa.array(docs, pa.int64()), pa.array(lines, pa.int32()))


def _common(left: list[np.ndarray], right: list[np.ndarray], ok: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets, where ok; few at a time or, where
    many are asked for, as products of matrices with a column for each word."""
    out = np.zeros(ok.shape, np.int64)
    i, j = np.nonzero(ok)
    if len(i) <= 4 * (len(left) + len(right)):
        out[i, j] = [len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        return out
    rows, cols = np.unique(i), np.unique(j)
    sets = [left[k] for k in rows.tolist()] + [right[k] for k in cols.tolist()]
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, word, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Words of one set only add nothing.
    shared = np.flatnonzero(times > 1)
    place = np.full(len(times), -1)
    place[shared] = np.arange(len(shared))
    word = place[word]
    part = np.zeros((len(rows), len(cols)), np.float32)
    for at in range(0, len(shared), COLUMNS):
        here = (word >= at) & (word < at + COLUMNS)
        grid = np.zeros((len(sets), min(COLUMNS, len(shared) - at)), np.float32)
        grid[owner[here], word[here] - at] = 1
        part += grid[: len(rows)] @ grid[len(rows) :].T
    out[np.ix_(rows, cols)] = part.astype(np.int64)
    return np.where(ok, out, 0)


def drop_lines(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with the lines removed that match an earlier one; texts that keep no
    line become empty. doc_id should be unique: rows that share one lose the
    lines that any of them loses."""
    gone = line_classes(docs, percent).where("NOT kept").groupBy(F.col("doc_id").alias("__id")).agg(F.collect_set("line_no").alias("__gone"))
    df = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    rest: Column = F.filter(F.split("text", "\n", -1), lambda x, i: ~F.array_contains(F.col("__gone"), i))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(rest, "\n"))
    return df.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH t AS (SELECT doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS ls FROM documents),
u AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS l FROM t),
v AS (SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(l, '[^\x20\x09-\x0D]+'))) AS ws FROM u),
c AS (SELECT ws, min((doc_id, line_no)) AS first, count(*) AS n, len(ws) AS k, row_number() OVER () AS id FROM v WHERE len(ws) > 0 GROUP BY ws),
e AS (SELECT id, k, unnest(ws) AS w FROM c),
p AS (SELECT a.id AS a, b.id AS b, any_value(a.k) AS ka, any_value(b.k) AS kb, count(*) AS n FROM e a JOIN e b ON a.w = b.w AND a.id <> b.id AND 5 * a.k >= 4 * b.k AND 5 * b.k >= 4 * a.k GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * n >= 80 * (ka + kb - n)),
o AS (SELECT l.a, min(c.first) AS first, sum(c.n) AS n FROM l JOIN c ON c.id = l.b GROUP BY l.a),
r AS (SELECT c.ws, c.first, c.n, least(c.first, coalesce(o.first, c.first)) AS earliest, c.n - 1 + coalesce(o.n, 0) AS n_links FROM c LEFT JOIN o ON o.a = c.id)
SELECT v.doc_id, v.line_no, len(v.ws) AS n_words, r.first[1] AS class_doc, r.first[2] AS class_line, r.n AS class_size,
       CAST(coalesce(r.n_links, 0) AS BIGINT) AS n_links, coalesce((v.doc_id, v.line_no) = r.earliest, true) AS kept
FROM v LEFT JOIN r ON v.ws = r.ws
"""
