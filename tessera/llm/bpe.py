"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Texts are handled one at a time inside Arrow batches, so memory follows the
batch. A text over LONG characters is cut where the split pattern must end a
match anyway: after a character that is no white space and before a space or a
line feed. No match of the pattern spans such a place and its only look-ahead
asks what follows white space, so the pieces encode as the whole text would. A
long text without such a place is encoded in one piece.
"""
import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = 65_536
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


@functools.lru_cache(maxsize=1)
def encoding(rank_bytes: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_bytes.splitlines()) if a}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = LONG) -> Iterator[str]:
    """text in parts of about size characters, cut at safe places only."""
    at = 0
    while len(text) - at > size and (cut := _SAFE.search(text, at + size)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(enc, text: str | None, size: int = LONG) -> list[int]:
    if not text:
        return []
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for part in pieces(text, size):
        ids += enc.encode_ordinary(part)
    return ids


def read_ranks(rank_file: str) -> bytes:
    """The rank file, read on the driver; it goes to workers with the function."""
    with open(rank_file, "rb") as f:
        return f.read()


def encoded(enc, batch: pa.Array) -> pa.ListArray:
    ids = [np.asarray(encode_text(enc, t.as_py()), np.int32) for t in batch]
    ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))


def decoded(enc, batch: pa.Array) -> pa.Array:
    return pa.array([enc.decode_bytes(x.as_py() or []) for x in batch], pa.binary())


def encode(text: Column, rank_file: str, pattern: str) -> Column:
    """array<int> of token ids, without special tokens. A null text counts as
    empty; an empty text has no ids."""
    ranks = read_ranks(rank_file)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(ranks, pattern)
        for batch in batches:
            yield encoded(enc, batch)

    return run.asNondeterministic()(text)


def decode(ids: Column, rank_file: str, pattern: str) -> Column:
    """The raw bytes of an array<int> of token ids; null counts as no ids. An id
    that the rank file lacks raises KeyError."""
    ranks = read_ranks(rank_file)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(ranks, pattern)
        for batch in batches:
            yield decoded(enc, batch)

    return run.asNondeterministic()(ids)


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, token_ids, decoded): ids of each whole text, and the bytes that
    these ids decode to. One row per row of docs, repeated rows and null doc_id
    included; other columns of docs are not looked at; a map without shuffle."""
    ranks = read_ranks(rank_file)

    @F.arrow_udf("struct<token_ids: array<int>, decoded: binary>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoding(ranks, pattern)
        for batch in batches:
            ids = encoded(enc, batch)
            yield pa.StructArray.from_arrays([ids, decoded(enc, ids)], ["token_ids", "decoded"])

    # One function for both ways: a second one would take a worker of its own in every task.
    trip = docs.select(F.col(id_col).alias("doc_id"), both.asNondeterministic()(F.col(text_col)).alias("t"))
    return trip.select("doc_id", "t.token_ids", "t.decoded")


def summary(trip: DataFrame) -> DataFrame:
    """Digests of what round_trip returns."""
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return trip.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return summary(round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
