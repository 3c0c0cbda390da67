"""Secret scan with corpus-wide ownership frequency.

Candidates are matches of fixed patterns. Each candidate's value is hashed and
the hashes are aggregated over the whole corpus by distinct repository and
owner: what few owners have, in however many repositories of theirs, looks like a
live credential and gets a span of kind ``live``; what many owners have is a
widely copied example. Built-in functions only.
"""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, join_groups

# Patterns of the base rule, the group that holds the value, and
# the least characters of that group.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: For these kinds the least length can stand in the pattern without changing
#: what is found: a match is always a whole run, and no part of a short run is long.
FAST = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: A value that this many owners have is a widely copied example.
EXAMPLE_OWNERS = 3


def _parts(text: Column, pattern: str, group: int) -> Column:
    """array(struct(gap, len, value)): the texts between the matches tell where
    each begins. The last has a gap only; without a match the array is empty."""
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    value = F.regexp_extract_all(text, F.lit(pattern), group)
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(F.transform(gaps, lambda g: F.length(g)).alias("gap"), F.transform(whole, lambda m: F.length(m)).alias("len"), value.alias("value"))
    return F.when(text.rlike(pattern), parts).otherwise(F.array().cast("array<struct<gap:int,len:int,value:string>>"))


def _groups(parts: Column) -> Column:
    """The parts in about sqrt(n) runs of about sqrt(n). A fold that collects an
    array copies it at every step, so runs are folded one by one."""
    n = F.size(parts)
    side = F.greatest(F.lit(32), F.ceil(F.sqrt(n))).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / side).cast("int")), lambda i: F.slice(parts, i * side + 1, side))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<array<struct<gap:int,len:int,value:string>>>"))


def _starts(groups: Column) -> Column:
    """Where each run begins in the text."""
    width = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda acc, x: acc + x["gap"] + F.coalesce(x["len"], F.lit(0))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(width, zero, lambda acc, w: F.struct((acc["at"] + w).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _spans(groups: Column, starts: Column, kind: str, least: int) -> Column:
    """array(struct(kind, start, end, value_hash)) of values of at least ``least``."""
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + x["len"]
        more = F.when(F.length(x["value"]) >= least, F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).otherwise(empty)
        return F.when(x["len"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], more).alias("out")))

    each = F.zip_with(groups, starts, lambda g, at: F.aggregate(g, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc["out"]))
    return F.transform(F.flatten(each), lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.unhex(F.sha2(s["value"], 256)).alias("value_hash")))


def owner_of(repo: Column) -> Column:
    """The owner in a repository's name ``owner/name``; the whole name without a slash."""
    return F.substring_index(repo, "/", 1)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None) -> DataFrame:
    """doc_id, text_key (a digest of the text), owner, repo, and an array of
    (kind, start, end, value_hash) per kind. The secrets themselves go no
    further than this."""
    text, repo = F.coalesce(F.col(text_col), F.lit("")), F.col(repo_col).cast("string")
    owner = owner_of(repo) if owner_col is None else F.col(owner_col).cast("string")
    df = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), owner.alias("owner"), repo.alias("repo"))
    keys, names = ["doc_id", "owner", "repo"], [k for k, *_ in KINDS]
    # Step by step, as every array is used more than once.
    df = df.select(*keys, F.unhex(F.sha2("text", 256)).alias("text_key"), *[_parts(F.col("text"), FAST.get(k, p), g).alias(k) for k, p, g, _ in KINDS])
    df = df.select(*keys, "text_key", *[_groups(F.col(k)).alias(k) for k in names])
    df = df.select(*keys, "text_key", *names, *[_starts(F.col(k)).alias(f"{k}_at") for k in names])
    return df.select("doc_id", "text_key", "owner", "repo", *[_spans(F.col(k), F.col(f"{k}_at"), k, n).alias(k) for k, _, _, n in KINDS])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "source", owner_col: str | None = None, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """doc_id, the base counts, base_spans (array of ``kind:start:end``) and all
    spans, with a ``live`` span for each candidate whose value fewer than
    ``example_owners`` owners have. The owner is that of the repository's name,
    unless a column tells it.

    One row per row of docs, repeated rows and null doc_id included; null and
    empty texts have no spans; a null owner counts as one owner; other columns
    aren't looked at."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "secrets")
    found = scratch.keep(candidates(docs, id_col, text_col, repo_col, owner_col), "candidates")
    names = [k for k, *_ in KINDS]
    each = found.where(sum((F.size(k) for k in names), F.lit(0)) > 0).select("doc_id", "text_key", "owner", "repo", F.explode(F.concat(*names)).alias("s"))
    each = each.select("doc_id", "text_key", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repo", F.lit("\0")).alias("repo"), "s.kind", "s.start", "s.end", "s.value_hash")
    # Two steps with partial sums, so that a value in a third of all rows is one
    # row for each owner and task when it is shuffled.
    seen = each.groupBy("value_hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    owners = seen.groupBy("value_hash").agg(F.count_distinct("owner").alias("owners"), F.count_distinct("repo").alias("repos"), F.sum("n").alias("n_rows"))
    owners = scratch.keep(owners, "owners")
    verdict = join_groups(each, owners, "value_hash", "n_rows").where(F.col("owners") < example_owners).select("doc_id", "text_key", "start", "end")
    # Repeated rows have the same key and the same candidates: a set for each key.
    live = verdict.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("live"))
    live = live.withColumnsRenamed({"doc_id": "live_id", "text_key": "live_key"})
    df = found.join(live, F.col("doc_id").eqNullSafe(F.col("live_id")) & (F.col("text_key") == F.col("live_key")), "left")
    rank = {k: i for i, k in enumerate([*names, "live"])}
    plain = lambda c, k: F.transform(c, lambda s: F.struct(s["start"].alias("start"), F.lit(rank[k]).alias("rank"), s["end"].alias("end"), F.lit(k).alias("kind")))
    base = F.concat(*[plain(k, k) for k in names])
    marks = F.coalesce(plain("live", "live"), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>"))
    text = lambda c: F.transform(F.array_sort(c), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return df.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in names], text(base).alias("base_spans"), text(F.concat(base, marks)).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = [f"n_{k}" for k, *_ in KINDS]
    return df.select("doc_id", *n, F.sha2(F.array_join("base_spans", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


def sql() -> str:
    """The same in DuckDB."""
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        rx = pattern.replace("'", "''")
        parts.append(f"""
{kind}_m AS (SELECT doc_id, source, text, regexp_extract_all(t, '{rx}') AS m, regexp_extract_all(t, '{rx}', {group}) AS v, string_split_regex(t, '{rx}') AS g
  FROM (SELECT doc_id, source, text, coalesce(text, '') AS t FROM documents)),
{kind} AS (SELECT doc_id, source, text, {rank} AS rank, '{kind}' AS kind, s AS start, s + length(mm) AS "end", vv AS value FROM
  (SELECT doc_id, source, text, m[i] AS mm, v[i] AS vv, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s
   FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {kind}_m)) WHERE length(vv) >= {least})""")
    names = [k for k, *_ in KINDS]
    return "WITH" + ",".join(parts) + f""",
every AS ({' UNION ALL '.join(f'SELECT * FROM {k}' for k in names)}),
owners AS (SELECT value, count(DISTINCT coalesce(split_part(source, '/', 1), chr(1))) AS n FROM every GROUP BY value),
spans AS (SELECT doc_id, rank, kind, start, "end" FROM every
  UNION ALL SELECT DISTINCT doc_id, {len(names)}, 'live', start, "end" FROM every JOIN owners USING (value) WHERE n < {EXAMPLE_OWNERS}),
joined AS (SELECT doc_id, {', '.join(f"count(*) FILTER (rank = {i}) AS n_{k}" for i, k in enumerate(names))},
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank, "end") FILTER (rank < {len(names)}) AS base,
  string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank, "end") AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in names)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id"""
