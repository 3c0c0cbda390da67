"""Exact dedup against a persistent digest index.

The index is a table of (digest, keep_id, n_rows), bucketed and sorted by
digest, at a location of the caller. A batch of documents is reduced to one row
per digest (partial aggregates before the shuffle, so a text that fills a third
of the rows is one row per task), anti-joined with the index by a sort-merge
join, and what is new is appended. Digests are SHA-256 of the whole UTF-8 text.
"""
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, delete, join_groups

#: Rows that go are broadcast up to this number (about 40 MB).
FEW_GONE = 1 << 19


class DigestIndex:
    """``location`` must be a folder that driver and executors share. An index
    that is there already is opened with the bucket count it was made with."""

    def __init__(self, spark: SparkSession, location: str, buckets: int = 64):
        self.spark, self.location, self.buckets = spark, location, buckets
        self.name = f"digest_index_{uuid.uuid5(uuid.NAMESPACE_URL, location).hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, n_rows BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{location}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Add one row for each digest that the index lacks."""
        new = groups.hint("merge").join(self.rows().hint("merge"), "digest", "left_anti")
        (new.select("digest", "keep_id", "n_rows").repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.insertInto(self.name))
        self.spark.catalog.refreshTable(self.name)


    def remove(self) -> None:
        """Forget the index and delete its files."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.location)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest) of each row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


def exact_dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest.

    The row with the largest doc_id of a text stays, unless the index knew the
    text before: then the indexed row stays and all rows of this batch go.
    group_size counts the rows of the batch with that text. Rows that repeat
    entirely (same doc_id, same text) are all marked as kept; ``drop_copies``
    leaves one of them. A null doc_id stays only if no other row has its text;
    its keep_id is then null. Other columns of docs are not looked at. An empty
    table gives no rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    marks = scratch.keep(digests(docs, id_col, text_col), "digests")
    groups = scratch.keep(marks.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n_rows")), "groups")
    index.append(groups)
    held = groups.select("digest", "n_rows").join(index.rows().select("digest", "keep_id"), "digest")
    found = join_groups(marks, scratch.keep(held, "held"), "digest", "n_rows")
    return found.select("doc_id", "keep_id", F.col("n_rows").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def fresh_index(spark: SparkSession) -> DigestIndex:
    """An empty index in the shared folder; as many buckets as shuffle partitions."""
    scratch = Scratch(spark, "digest-index")
    return DigestIndex(spark, scratch.path("index"), int(spark.conf.get("spark.sql.shuffle.partitions")))


def first_batch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """exact_dedup against an empty index that is gone afterwards."""
    index = fresh_index(docs.sparkSession)
    found = exact_dedup(docs, index, id_col, text_col)
    index.remove()
    return found


def drop_copies(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; one of each set of
    entirely repeated rows (by id and text).

    Texts stay where they are while those that go can be broadcast by id and
    digest (FEW_GONE); only rows that repeat entirely are shuffled."""
    scratch = Scratch(docs.sparkSession, "copies")
    found = first_batch(docs, id_col, text_col) if index is None else exact_dedup(docs, index, id_col, text_col)
    marks = found.groupBy("doc_id", "digest", "kept").agg(F.count(F.lit(1)).alias("n"))
    marks = marks.where("NOT kept OR n > 1").select(F.col("doc_id").alias("__id_gone"), F.col("digest").alias("__digest_gone"), "kept")
    marks = scratch.keep(marks, "marks", again=F.col("kept"))
    few = lambda df: F.broadcast(df) if marks.n_rows <= FEW_GONE else df
    same = F.col(id_col).eqNullSafe(F.col("__id_gone")) & (F.col("__digest_own") == F.col("__digest_gone"))
    all_ = docs.withColumn("__digest_own", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    out = all_.join(few(marks), same, "left_anti")
    if marks.again:
        out = out.unionByName(all_.join(few(marks.where("kept")), same, "left_semi").dropDuplicates([id_col, "__digest_own"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = first_batch(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
