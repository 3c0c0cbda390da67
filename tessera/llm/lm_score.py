"""Language-model scoring with a log-frequency Bloom filter.

N-gram counts of the training documents are quantised to powers of two and an
n-gram with level q is entered q times, as (n-gram, 1) to (n-gram, q). The
filter goes to the workers; a count is read back by probing levels until one is
missing, so it is never read too low, and too high with the filter's false
positive rate. The model interpolates the bigram estimate with an add-one-half
unigram estimate.

Counting is a scan with partial counts per task and one shuffle. The filter has
ENTRY_BITS for each entry, whatever their number, and the base score needs exact
unigram counts. Up to MOST_BITS and MOST_WORDS are broadcast at once; more are
written tables whose parts are broadcast one after the other. Each pass over the
texts then writes the levels and the sums of its part, without texts, so that false
positives don't grow with the input and the disk doesn't grow faster than it.
"""
import functools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch
from . import words
from .words import mix

ENTRY_BITS, PROBES = 10, 4
SEGMENT = 1 << 20
#: Bounds of what is broadcast at once: bits of the filter, words with exact counts.
MOST_BITS, MOST_WORDS = 1 << 31, 1 << 23
#: Words of a pass at least, whatever bound is given.
LEAST_WORDS = 1 << 12
#: Weight of the bigram estimate.
BIGRAM = 0.7
#: Bytes of text that a worker scores at once, and tokens that it counts together.
CHUNK, COUNTED = 1 << 21, 1 << 22
#: N-grams that are entered into the filter at once.
ROWS = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: The end of a text, which no word can be; also what comes before the first word.
END = xxhash.xxh3_64_intdigest(b" ")


def pairs(h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(history, bigram) hashes of tokens of texts that begin at starts."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[starts] = END
    return before, mix(before * _ODD + h)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of each text and its end, first token of each text)."""
    h, n = words.counted(texts)
    starts = np.cumsum(n + 1) - (n + 1)
    out = np.full(len(h) + len(n), END, np.uint64)
    word = np.ones(len(out), bool)
    word[starts + n] = False
    out[word] = h
    return out, starts


def _texts(batches: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, tokens, starts) in parts of about ``size`` bytes of text."""
    for batch in batches:
        for at, some in words.parts(batch.column("text"), size):
            yield batch.slice(at, len(some)), *tokens(some)


def ngram_counts(train: DataFrame, shards: int) -> DataFrame:
    """(order, h, n) of all unigrams and bigrams of train (text)."""
    keys = _dealt(train.sparkSession, shards)

    def counted(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for order, grams in enumerate(zip(*held, strict=True), 1):
            grams, n = np.unique(np.concatenate(grams), return_counts=True)
            shard = ((grams >> np.uint64(44)) * np.uint64(shards)) >> np.uint64(20)
            yield pa.RecordBatch.from_arrays([pa.array(keys[shard.astype(np.int64)]), pa.array(np.full(len(grams), order, np.int8)), pa.array(grams.view(np.int64)), pa.array(n)], ["shard", "order", "h", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, h, starts in _texts(batches):
            held.append([h, pairs(h, starts)[1]])
            n += len(h)
            if n > COUNTED:
                yield from counted(held)
                held, n = [], 0
        if held:
            yield from counted(held)

    each = train.select("text").mapInArrow(run, "shard int, order byte, h long, n long")
    # Dealt by shard, a range of hashes, so that a written file covers few segments of the filter.
    return each.repartition(shards, "shard").groupBy("shard", "order", "h").agg(F.sum("n").alias("n")).select("order", "h", "n")


def _dealt(spark: SparkSession, n: int) -> np.ndarray:
    """For each of n partitions a number that is dealt to it by hash, so that as
    many shards fill all partitions evenly."""
    number = F.col("id").cast("int")
    found = spark.range(32 * n + 64).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("p")).agg(F.min(number).alias("k")).collect()
    out = np.arange(n, dtype=np.int32)
    for r in found:
        out[r["p"]] = r["k"]
    return out


class LogFilter:
    """The filter as packed segments, or those from ``first`` on of ``count``;
    an n-gram's probes stay in one segment."""

    def __init__(self, segments: np.ndarray, first: int = 0, count: int | None = None):
        self.segments = segments  # (held, SEGMENT // 8) bytes
        self.first, self.count = first, count or len(segments)

    @staticmethod
    def segment(h: np.ndarray, count: int) -> np.ndarray:
        return (((h >> np.uint64(40)) * np.uint64(count)) >> np.uint64(24)).astype(np.int64)

    @staticmethod
    def spots(h: np.ndarray, order: int, level: int) -> Iterator[np.ndarray]:
        x = mix(h + np.uint64((order * int(_ODD) + level * 0xD6E8FEB86659FD93) % (1 << 64)))
        step = (x >> np.uint64(32)) | np.uint64(1)
        for _ in range(PROBES):
            yield (x % np.uint64(SEGMENT)).astype(np.int64)
            x = x + step

    def levels(self, h: np.ndarray, order: int) -> np.ndarray:
        """The level of each n-gram, 0 for one that isn't there or whose segment isn't held."""
        out = np.zeros(len(h), np.int32)
        own = self.segment(h, self.count) - self.first
        flat, base = self.segments.reshape(-1), own * (SEGMENT // 8)
        alive, level = np.flatnonzero((own >= 0) & (own < len(self.segments))), 1
        while len(alive) and level < 64:
            at, keep = base[alive], np.ones(len(alive), bool)
            for spot in self.spots(h[alive], order, level):
                keep &= (flat[at + (spot >> 3)] >> (spot & 7).astype(np.uint8)) & 1 == 1
            alive = alive[keep]
            out[alive] = level
            level += 1
        return out


def count_of(level: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level: 2**(level - 1) to 2**level - 1."""
    return np.where(level > 0, (3 * np.exp2(level - 1.0) - 1) / 2, 0.0)


def n_segments(entries: int) -> int:
    return max(1, -(-entries * ENTRY_BITS // SEGMENT))


def build_filter(counts: DataFrame, entries: int) -> LogFilter:
    n = n_segments(entries)
    return _held(filter_table(counts, n), 0, n, n)


def _held(table: DataFrame, first: int, end: int, count: int) -> LogFilter:
    out = np.zeros((end - first, SEGMENT // 8), np.uint8)
    for r in table.toLocalIterator():
        out[r["segment"] - first] = np.frombuffer(r["bits"], np.uint8)
    return LogFilter(out, first, count)


def filter_table(counts: DataFrame, n: int) -> DataFrame:
    """(segment, bits) of a filter of n segments, without empty ones."""

    def enter(found: dict[int, np.ndarray], h: np.ndarray, order: np.ndarray, count: np.ndarray) -> None:
        top, where = np.frexp(count.astype(np.float64))[1], LogFilter.segment(h, n)
        for k in np.unique(order).tolist():
            by = np.flatnonzero(order == k)
            by = by[np.argsort(where[by], kind="stable")]
            for at, end in _runs(where[by]):
                part, least = h[by[at:end]], top[by[at:end]]
                bits = np.zeros(SEGMENT, bool)
                for level in range(1, int(least.max()) + 1):
                    part, least = part[least >= level], least[least >= level]
                    for spot in LogFilter.spots(part, k, level):
                        bits[spot] = True
                own = int(where[by[at]])
                packed = np.packbits(bits, bitorder="little")
                found[own] = found[own] | packed if own in found else packed

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for h, order, count in _gathered(batches):
            enter(found, h.view(np.uint64), order, count)
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([b.tobytes() for b in found.values()], pa.binary())], ["segment", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, bits in zip(batch.column("segment").to_pylist(), batch.column("bits"), strict=True):
                x = np.frombuffer(bits.as_py(), np.uint8)
                found[i] = found[i] | x if i in found else x
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([b.tobytes() for b in found.values()], pa.binary())], ["segment", "bits"])

    kind = "segment int, bits binary"
    return counts.mapInArrow(fill, kind).repartition("segment").mapInArrow(merge, kind)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns h, order and n of about ROWS rows at a time."""
    held, n = [], 0
    for batch in batches:
        held.append([batch.column(c).to_numpy() for c in ("h", "order", "n")])
        n += batch.num_rows
        if n >= ROWS:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _runs(x: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])) if len(x) else np.zeros(1, int)
    return zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _word_table(counts: DataFrame, v: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the v training words and their counts; a table of checked
    size, which arrives part by part."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).to_numpy().tobytes()], pa.binary()) for c in ("h", "n")], ["h", "n"])

    h, n, at = np.empty(v, np.uint64), np.empty(v, np.int64), 0
    for r in counts.where("order = 1").select("h", "n").mapInArrow(pack, "h binary, n binary").toLocalIterator():
        k = len(r["h"]) // 8
        h[at : at + k], n[at : at + k] = np.frombuffer(r["h"], np.uint64), np.frombuffer(r["n"], np.int64)
        at += k
    if not v or n.max() < 1 << 32:
        n = n.astype(np.uint32)
    by = np.argsort(h)
    return h[by], n[by]


def scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", most_words: int = MOST_WORDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: a row for
    each row of docs; ``train`` tells the rows to learn from (null: not).

    A null text counts as empty: its only token is the end. With nothing to
    learn from every token has base probability 1. Repeated rows and null doc_id
    are scored like others; other columns aren't looked at; an empty table gives
    no rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm-score")
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = scratch.keep(ngram_counts(docs.where("train"), shards), "counts")
    one = F.col("order") == 1
    level = F.length(F.bin("n"))
    told = counts.agg(F.sum(F.when(one, F.col("n"))).alias("n"), F.count(F.when(one, 1)).alias("v"), F.sum(level).alias("entries")).first()
    n, v = told["n"] or 0, told["v"]
    size = n_segments(told["entries"] or 0)
    passes = max(-(-size // max(1, MOST_BITS // SEGMENT)), -(-v // max(most_words, LEAST_WORDS)))
    scratch.release()
    kind = docs.schema["doc_id"].dataType.simpleString()
    if passes > 1:
        return _in_passes(scratch, docs.select("doc_id", "text"), counts, size, n, v, passes)
    shared = spark.sparkContext.broadcast((build_filter(counts, told["entries"] or 0).segments, *_word_table(counts, v)))
    return docs.select("doc_id", "text").mapInArrow(_scorer(shared, n, v), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _in_passes(scratch: Scratch, docs: DataFrame, counts: DataFrame, size: int, n: int, v: int, passes: int) -> DataFrame:
    """The rows of scores, where filter or words are too many to broadcast at once.

    Each pass has a range of the filter's segments and a share of the words. It
    reads docs again and writes, by id and digest of the text, the levels that it
    found (a byte for a token's unigram and bigram, compressed) and its part of the
    sums; no text is written or shuffled. Rows that share both keys are scored once."""
    table, known = scratch.keep(filter_table(counts, size), "filter"), scratch.keep(counts.where("order = 1"), "words")
    scratch.drop(counts)
    kind, total = docs.schema["doc_id"].dataType.simpleString(), n + 0.5 * (v + 1)
    names = ["doc_id", "text_key", "n_tokens", "n_known", "base", "one", "two"]
    parts = []
    for k in range(passes):
        first, end = size * k // passes, size * (k + 1) // passes
        held = _held(table.where((F.col("segment") >= first) & (F.col("segment") < end)), first, end, size)
        own_words = known.where(F.pmod("h", F.lit(passes)) == k)
        shared = scratch.spark.sparkContext.broadcast((held.segments, *_word_table(own_words, own_words.count())))
        del held

        def run(batches: Iterator[pa.RecordBatch], first=first, shared=shared) -> Iterator[pa.RecordBatch]:
            segments, known_words, word_n = shared.value
            model = LogFilter(segments, first, size)
            for rows, h, starts in _texts(batches):
                own, back = np.unique(h, return_inverse=True)
                c = _counted(own, known_words, word_n)
                log = np.where(c > 0, np.log10((c + 0.5) / total), 0.0)
                cuts = [*starts.tolist(), len(h)]
                found = [model.levels(own, 1)[back].astype(np.uint8), model.levels(pairs(h, starts)[1], 2).astype(np.uint8)]
                one, two = ([zlib.compress(x[a:b].tobytes(), 1) for a, b in zip(cuts, cuts[1:])] for x in found)
                keys = [xxhash.xxh3_128_digest(t.as_py() or "") for t in rows.column("text")]
                sums = [np.add.reduceat((c > 0)[back].astype(np.int64), starts), np.add.reduceat(log[back], starts)]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(keys, pa.binary()), pa.array(np.diff(cuts)), *map(pa.array, sums), pa.array(one, pa.binary()), pa.array(two, pa.binary())], names)

        part = docs.mapInArrow(run, f"doc_id {kind}, text_key binary, n_tokens long, n_known long, base double, one binary, two binary")
        parts.append(scratch.keep(part, "levels").select("doc_id", "text_key", F.lit(k).alias("pass"), F.struct(*names[2:]).alias("found")))
        shared.unpersist()
        scratch.release()
    scratch.drop(table, known)
    # Equal rows of a pass have equal parts, so the largest is any of them.
    each = functools.reduce(DataFrame.unionByName, parts).groupBy("doc_id", "text_key").agg(F.count(F.when(F.col("pass") == 0, 1)).alias("n_rows"), *[F.max(F.when(F.col("pass") == k, F.col("found"))).alias(f"p{k}") for k in range(passes)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, known, base, out = [], [], [], []
            for found in zip(*(batch.column(f"p{k}") for k in range(passes)), strict=True):
                found = [x.as_py() for x in found]
                one, two = (functools.reduce(np.bitwise_or, [np.frombuffer(zlib.decompress(x[c]), np.uint8) for x in found]) for c in ("one", "two"))
                tokens.append(len(one))
                known.append(sum(x["n_known"] for x in found))
                base.append(sum(x["base"] for x in found) + (tokens[-1] - known[-1]) * math.log10(0.5 / total))
                single = count_of(one.astype(np.int32))
                # The last token is the end, which also comes before the first.
                out.append(float(_log(single, np.roll(single, 1), count_of(two.astype(np.int32)), total).sum()))
            columns = [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(out), n)), pa.array(base, pa.float64()), pa.array(out, pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_rows"), *columns], ["doc_id", "n_rows", *NAMES[1:]])

    scored = each.mapInArrow(score, f"doc_id {kind}, n_rows long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows"))).select(*NAMES)


NAMES = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def _counted(own: np.ndarray, known_words: np.ndarray, word_n: np.ndarray) -> np.ndarray:
    """The training counts of words, 0 for those that aren't in the sorted known_words."""
    if not len(known_words):
        return np.zeros(len(own))
    at = np.minimum(np.searchsorted(known_words, own), len(known_words) - 1)
    return np.where(known_words[at] == own, word_n[at], 0).astype(np.float64)


def _log(single: np.ndarray, before: np.ndarray, together: np.ndarray, total: float) -> np.ndarray:
    """log10 of each token's probability, from its count, that of what comes before
    and that of both. A history that was never seen tells nothing: there the unigram
    has all the weight."""
    share = np.where(before > 0, BIGRAM, 0.0)
    p = share * together / np.maximum(np.maximum(before, together), 1) + (1 - share) * (single + 0.5) / total
    return np.log10(np.minimum(p, 1))


def _scorer(shared, n: int, v: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, known_words, word_n = shared.value
        model, total = LogFilter(segments), n + 0.5 * (v + 1)
        for rows, h, starts in _texts(batches):
            own, back = np.unique(h, return_inverse=True)
            c = _counted(own, known_words, word_n)
            ends = np.diff(np.append(starts, len(h)))
            base = np.add.reduceat(np.log10((c + 0.5) / total)[back], starts)
            known = np.add.reduceat((c > 0)[back].astype(np.int64), starts)
            single = count_of(model.levels(own, 1))
            # What comes before: the token before, or at a start the end of another text.
            before = np.empty(len(h))
            before[1:] = single[back][:-1]
            before[starts] = single[np.searchsorted(own, np.uint64(END))]
            score = np.add.reduceat(_log(single[back], before, count_of(model.levels(pairs(h, starts)[1], 2)), total), starts)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ends), pa.array(known), pa.array(np.full(rows.num_rows, n)), pa.array(base), pa.array(score)], NAMES)

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    found = scores(docs, learn)
    return found.select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
