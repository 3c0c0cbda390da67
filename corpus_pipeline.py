"""A pipeline over documents: language, copies, near copies, leaks, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
and read again before the next stage, so a lost executor costs one stage at most
and every stage sees all that its predecessor kept. All but the last return the
columns of documents."""
import public_tokenizers

from tessera.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup
from tessera.runtime import Scratch, ready


def language(spark, docs, sf_dir):
    """Documents without a language (null text or no letter) go."""
    ready(spark)
    return language_id.known_language(docs)


def exact(spark, docs, sf_dir):
    """Of equal texts the one with the largest doc_id stays."""
    ready(spark)
    return exact_dedup.drop_copies(docs)


def near(spark, docs, sf_dir):
    """Of each group by five-word shingles and similarity 0.8 the smallest doc_id stays."""
    ready(spark)
    return near_dedup.drop_near_copies(docs, width=5, percent=80)


def leaks(spark, docs, sf_dir):
    """Documents with a benchmark passage go."""
    ready(spark)
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark, docs, sf_dir):
    """Token ids of each document and back, as digests."""
    ready(spark)
    return bpe.summary(bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("language id", language),
    ("exact dedup", exact),
    ("near dedup", near),
    ("decontamination", leaks),
    ("bpe", tokens),
]

#: SQL can't express the network of the first stage or the latent search.
ORACLE_SQL = None


def run(spark, sf_dir):
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
