"""Session helpers: tables, the shared scratch folder, and code on workers."""
import ctypes
import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .errors import InvalidArgumentError

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Arrow batches: rows may be long texts, so they are small in rows and in bytes.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


#: Python workers live on between tasks; they shall give memory back that they don't use.
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(4 << 20)}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, and
    bound what they hold, where the session doesn't say how.

    On a cluster the package is shipped with ``--py-files``; the path is only
    added to what the workers search."""
    given = spark.sparkContext.getConf()
    for key, value in BATCHES.items():
        if not given.contains(key):
            spark.conf.set(key, value)
    env = spark.sparkContext.environment
    for key, value in WORKERS.items():
        env.setdefault(key, value)
    known = env.get("PYTHONPATH", "")
    if _ROOT not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, known) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session leaves it unset and all runs in one process (tests) a
    local folder is made and set; on a cluster an unset folder raises."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master.split("[")[0] != "local":
            raise InvalidArgumentError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        path = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in any store that Spark reaches."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Scratch folders of this process, for clean_scratch.
_SCRATCH: list[str] = []


def clean_scratch(spark: SparkSession) -> None:
    """Delete all scratch folders made so far. DataFrames that were returned before
    may read them, so call it once their rows are written."""
    while _SCRATCH:
        delete(spark, _SCRATCH.pop())


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, which it does once
    the driver has collected the plans that they belong to, and give the driver's
    free memory back to the system.

    Python's references to plans wait up to a second in a queue of the gateway, so
    it is emptied first; else the last step's files would stay until the next call."""
    gc.collect()
    queue = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", None)
    while queue:
        try:
            held = queue.pop()
        except IndexError:  # the gateway's own thread took it
            break
        if not isinstance(held, tuple):  # the gateway is to stop
            queue.append(held)
            break
        held[0].garbage_collect_object(held[1], False)
    # Spark's event queues hold the last query, with its plan, until the next one ends.
    spark.sql("SELECT 1").collect()
    spark.sparkContext._jvm.System.gc()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


class Scratch:
    """Written tables in the shared folder; they cut lineage and survive the
    loss of any executor."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        _SCRATCH.append(self.root)
        self._n = 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str, **counts: Column) -> DataFrame:
        """Write df and read it again. The result knows ``n_rows``, and for each
        of ``counts`` how many rows have it true, from the write itself."""
        self._n += 1
        path = self.path(f"{self._n}-{name}")
        seen = Observation()
        sums = {"n_rows": F.count(F.lit(1))} | {k: F.count(F.when(c, 1)) for k, c in counts.items()}
        df.observe(seen, *[c.alias(k) for k, c in sums.items()]).write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        # A plan that Spark finds empty reports nothing.
        told = seen.get or out.agg(*[c.alias(k) for k, c in sums.items()]).first().asDict()
        for k in sums:
            setattr(out, k, told[k])
        return out

    def release(self) -> None:
        release(self.spark)

    def drop(self, *dfs: DataFrame) -> None:
        """Delete written tables that no later step reads."""
        for df in dfs:
            delete(self.spark, df._scratch_path)


#: A key is hot from this share of the rows on; there can't be more hot keys.
HOT_KEYS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, n_rows: str, also: Column | None = None) -> DataFrame:
    """Inner join of rows with one group row per key, where a key may hold any
    share of the rows. groups must be a written table. ``also`` is a condition on
    the joined rows, tested inside the join.

    Keys of at least 1/1000 of the rows (at most 1000 of them, whatever the
    input) are joined by broadcast, so that their rows stay where they are; the
    rest by a shuffle in which no key is large."""
    total = groups.agg(F.sum(n_rows)).first()[0] or 0
    least = max(1000, total // HOT_KEYS)
    hot = groups.where(F.col(n_rows) >= least)
    cold = groups.where(F.col(n_rows) < least)
    there = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    both = there.unionByName(rest)
    return both if also is None else both.where(also)
