"""Language ID by a small byte convolutional network.

Bytes are embedded, passed through filters of several widths, max-pooled over a
window of WINDOW bytes and classified by softmax. The network is trained in
numpy on the driver on a bounded sample: at most ``per_lang`` documents of every
language and four windows of each. Prediction reads
whole texts: every byte is in one window, and the windows' log-probabilities are
averaged by their bytes.
"""
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import release

WINDOW = 256
WIDTHS = (2, 3, 4)
PAD = 256
UNKNOWN = "und"


@dataclass
class Model:
    langs: list[str]
    emb: np.ndarray  # (257, D); the row PAD stays zero
    conv: np.ndarray  # (max width * D, filters); zero where a filter is narrower
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def _shape(widths: tuple[int, ...], dim: int, each: int) -> np.ndarray:
    mask = np.zeros((max(widths) * dim, each * len(widths)), np.float32)
    for i, w in enumerate(widths):
        mask[: w * dim, i * each : (i + 1) * each] = 1
    return mask


def windows(text: bytes) -> np.ndarray:
    """(n, WINDOW + max width - 1) codes of a text's windows, the last filled with PAD."""
    data = np.frombuffer(text, np.uint8)
    n = max(1, -(-len(data) // WINDOW))
    out = np.full((n, WINDOW + max(WIDTHS) - 1), PAD, np.int16)
    full = np.full(n * WINDOW, PAD, np.int16)
    full[: len(data)] = data
    out[:, :WINDOW] = full.reshape(n, WINDOW)
    return out


def _columns(codes: np.ndarray, emb: np.ndarray) -> np.ndarray:
    x, k = emb[codes], max(WIDTHS)
    return np.concatenate([x[:, i : i + WINDOW] for i in range(k)], axis=2).reshape(len(codes) * WINDOW, -1)


def log_probs(model: Model, codes: np.ndarray, block: int = 32) -> np.ndarray:
    """Log-probability of each language for each window."""
    out = np.empty((len(codes), len(model.langs)), np.float32)
    for i in range(0, len(codes), block):
        part = codes[i : i + block]
        top = (_columns(part, model.emb) @ model.conv).reshape(len(part), WINDOW, -1).max(axis=1)
        z = np.maximum(top + model.bias, 0) @ model.out + model.out_bias
        z -= z.max(axis=1, keepdims=True)
        out[i : i + block] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    return out


def train(samples: list[tuple[str, str]], dim: int = 8, each: int = 12, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Model:
    """Fit on (language, text) windows by Adam; the same samples give the same model."""
    langs = sorted({lang for lang, _ in samples})
    rng = np.random.default_rng(seed)
    mask = _shape(WIDTHS, dim, each)
    k = mask.shape[1]
    p = {
        "emb": rng.normal(0, 0.5, (257, dim)).astype(np.float32),
        "conv": rng.normal(0, 0.3, mask.shape).astype(np.float32) * mask,
        "bias": np.zeros(k, np.float32),
        "out": rng.normal(0, 0.1, (k, max(1, len(langs)))).astype(np.float32),
        "out_bias": np.zeros(max(1, len(langs)), np.float32),
    }
    p["emb"][PAD] = 0
    if len(langs) > 1:
        codes = np.concatenate([windows(t.encode().lower()[:WINDOW]) for _, t in samples])
        y = np.array([langs.index(lang) for lang, _ in samples])
        m, v, step = {n: np.zeros_like(a) for n, a in p.items()}, {n: np.zeros_like(a) for n, a in p.items()}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                take = order[i : i + batch]
                g = _gradient(p, codes[take], y[take], dim)
                g["conv"] *= mask
                g["emb"][PAD] = 0
                step += 1
                for n in p:
                    m[n] += 0.1 * (g[n] - m[n])
                    v[n] += 0.001 * (g[n] ** 2 - v[n])
                    p[n] -= rate * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)
    return Model(langs, **p)


def _gradient(p: dict, codes: np.ndarray, y: np.ndarray, dim: int) -> dict:
    n, rows = len(y), np.arange(len(y))
    cols = _columns(codes, p["emb"])
    conv = (cols @ p["conv"]).reshape(n, WINDOW, -1)
    at = conv.argmax(axis=1)
    top = np.take_along_axis(conv, at[:, None], 1)[:, 0] + p["bias"]
    h = np.maximum(top, 0)
    z = h @ p["out"] + p["out_bias"]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    d = z / z.sum(axis=1, keepdims=True)
    d[rows, y] -= 1
    d /= n
    dh = (d @ p["out"].T) * (top > 0)
    where = rows[:, None] * WINDOW + at  # the row of cols that each filter's maximum came from
    best = cols[where]  # (n, filters, width * dim)
    d_conv = np.einsum("nfc,nf->cf", best, dh)
    d_cols = p["conv"].T[None] * dh[:, :, None]
    d_emb = np.zeros_like(p["emb"])
    for k in range(max(WIDTHS)):
        np.add.at(d_emb, codes[rows[:, None], at + k], d_cols[:, :, k * dim : (k + 1) * dim])
    return {"emb": d_emb, "conv": d_conv, "bias": dh.sum(axis=0), "out": h.T @ d, "out_bias": d.sum(axis=0)}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 400, most: int = 80_000) -> Model:
    """Train on docs, which hold the rows to learn from. Rows with a null
    doc_id, text or language don't take part. Of each language at most
    ``per_lang`` rows are learned from, and fewer, but one at least, where all
    languages together would have more than ``most``. They are chosen by a hash of
    the doc_id, so they are the same for the same rows; rows that repeat entirely
    count once."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n_rows"))
    each = max(1, min(per_lang, most // max(1, sizes.count())))
    grain = 1 << 30
    share = F.least(F.lit(grain), (F.lit(2.0 * each * grain) / F.col("n_rows")).cast("long") + 1)
    some = known.withColumn("mark", F.pmod(F.xxhash64("doc_id"), F.lit(grain))).join(F.broadcast(sizes), "lang").where(F.col("mark") < share)
    spots = F.transform(F.array(*[F.lit(i) for i in range(4)]), lambda i: F.substring(F.col("text"), (F.length("text") * i / 4).cast("int") + 1, WINDOW))
    some = some.select("lang", "mark", "doc_id", spots.alias("spots")).distinct()
    first = F.row_number().over(Window.partitionBy("lang").orderBy("mark", "doc_id", "spots"))
    rows = some.withColumn("first", first).where(F.col("first") <= each).select("doc_id", "lang", "spots").collect()
    release(docs.sparkSession)
    return train([(r["lang"], s) for r in sorted(rows, key=lambda r: (r["doc_id"], r["lang"], r["spots"])) for s in r["spots"] if any(c.isalpha() for c in s)])


def predict_text(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text; UNKNOWN and 0 without a letter."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    todo: list[int] = []
    codes: list[np.ndarray] = []
    held = 0

    def flush():
        nonlocal held
        if not todo:
            return
        lp = log_probs(model, np.concatenate(codes))
        weight = np.concatenate([(c[:, :WINDOW] != PAD).sum(axis=1) for c in codes])
        ends = np.cumsum([0, *map(len, codes)])[:-1]
        mean = np.add.reduceat(lp * weight[:, None], ends) / np.add.reduceat(weight, ends)[:, None]
        prob = np.exp(mean - mean.max(axis=1, keepdims=True))
        prob /= prob.sum(axis=1, keepdims=True)
        for i, row in zip(todo, prob, strict=True):
            out[i] = model.langs[int(row.argmax())], float(row.max())
        todo.clear()
        codes.clear()
        held = 0

    for i, text in enumerate(texts):
        if model.langs and text and any(map(str.isalpha, text)):
            todo.append(i)
            codes.append(windows(text.encode().lower()))
            held += len(codes[-1])
            if held >= 4096:
                flush()
    flush()
    return out


def predict(text: Column, model: Model) -> Column:
    """struct(lang, score): one of the learned languages, or ``und`` and 0 where
    a text is null or has no letter (or nothing was learned). Looks at the text
    alone and adds no shuffle."""

    @F.arrow_udf("struct<lang: string, score: double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            got: list[tuple[str, float]] = []
            for i in range(0, len(batch), 512):
                got += predict_text(model, batch[i : i + 512].to_pylist())
            yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang", "score"])

    return run.asNondeterministic()(text)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from; false for a null doc_id (which isn't learned from either)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per row of docs, repeated
    rows and null doc_id included; an empty table gives no rows."""
    model = fit(docs.where(~held_out(id_col)), id_col, text_col, lang_col)
    found = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predict(F.col(text_col), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def known_language(docs: DataFrame, least: float = 0.0) -> DataFrame:
    """The rows of docs whose text has a language by a score of at least
    ``least``, with all their columns. Rejected: null texts, texts without a
    letter, and texts scored below ``least``."""
    model = fit(docs.where(~held_out()))
    marked = docs.withColumn("__language", predict(F.col("text"), model))
    stay = (F.col("__language.lang") != UNKNOWN) & (F.col("__language.score") >= least)
    return marked.where(stay).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
