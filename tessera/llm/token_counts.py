"""Token counts by greedy longest match, in time linear in the text.

The vocabulary is a trie whose nodes carry a failure link (where matching goes
on when no edge fits) and the number of pieces that following the link
completes. A word's count is then the sum over the links followed: no piece is
ever built and no character read twice (the construction is that of the
published linear-time word-piece algorithm).
"""
import functools
import json
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Symbol after the last byte of a word.
END = 256
_PARTS = re.compile(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_MEMO = 1 << 18


class Automaton:
    """Built from pieces given as tuples of symbols: bytes, and END at the end
    of pieces that close a word."""

    def __init__(self, vocabulary: Iterable[tuple[int, ...]]):
        self.edge: list[dict[int, int]] = [{}]
        final = [False]
        for piece in vocabulary:
            at = 0
            for s in piece:
                if s not in self.edge[at]:
                    self.edge[at][s] = len(self.edge)
                    self.edge.append({})
                    final.append(False)
                at = self.edge[at][s]
            final[at] = at != 0
        self.link = [-1] * len(self.edge)
        self.popped = [0] * len(self.edge)
        todo = deque([0])
        while todo:
            up = todo.popleft()
            for s, at in self.edge[up].items():
                todo.append(at)
                if final[at]:
                    self.link[at], self.popped[at] = 0, 1
                    continue
                back, n = self.link[up], self.popped[up]
                while back >= 0 and s not in self.edge[back]:
                    n += self.popped[back]
                    back = self.link[back]
                if back >= 0:
                    self.link[at], self.popped[at] = self.edge[back][s], n

    def count(self, word: bytes) -> int:
        """Pieces of one word; a word that the pieces can't spell counts as 1."""
        edge, link, popped = self.edge, self.link, self.popped
        at = n = 0
        for s in (*word, END):
            while s not in edge[at]:
                if link[at] < 0:
                    return 1
                n += popped[at]
                at = link[at]
            at = edge[at][s]
        while at:
            if link[at] < 0:
                return 1
            n += popped[at]
            at = link[at]
        return n


def byte_names() -> dict[str, int]:
    """The usual printable names of bytes in byte-level vocabularies: printable
    Latin-1 characters stand for themselves, the others follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    names = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return names | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> list[tuple[int, ...]]:
    """Pieces of a tokenizers JSON file with word ends ``</w>``; special tokens
    (not spelled in byte names) are left out."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    names, out = byte_names(), []
    for piece in vocab:
        body, end = (piece[:-4], (END,)) if piece.endswith("</w>") else (piece, ())
        if not piece.startswith("<|") and body and all(c in names for c in body):
            out.append(tuple(names[c] for c in body) + end)
    return out


@functools.lru_cache(maxsize=2)
def _automaton(vocabulary: tuple) -> Automaton:
    return Automaton(vocabulary)


def count_text(auto: Automaton, text: str | None, memo: dict[str, tuple[int, int]]) -> tuple[int, int]:
    """(words, tokens) of a whole text. memo: counts of words met before."""
    n_words = n_tokens = 0
    for chunk in (text or "").lower().split():
        got = memo.get(chunk)
        if got is None:
            parts = _PARTS.findall(chunk)
            got = len(parts), sum(auto.count(p.encode()) for p in parts)
            if len(memo) >= _MEMO:
                memo.clear()
            if len(chunk) <= 64:
                memo[chunk] = got
        n_words += got[0]
        n_tokens += got[1]
    return n_words, n_tokens


def counts(text: Column, vocabulary: list[tuple[int, ...]]) -> Column:
    """struct(n_words, n_tokens) of a text. Texts are lower-cased and split at
    white space, then into runs of letters, single digits and runs of other
    characters. Null and empty texts have 0 and 0."""
    vocab = tuple(vocabulary)

    @F.arrow_udf("struct<n_words: bigint, n_tokens: bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        auto, memo = _automaton(vocab), {}
        for batch in batches:
            got = [count_text(auto, t.as_py(), memo) for t in batch]
            yield pa.StructArray.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in (0, 1)], ["n_words", "n_tokens"])

    return run.asNondeterministic()(text)


def token_counts(docs: DataFrame, vocabulary: list[tuple[int, ...]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_tokens), one row per row of docs, repeated rows and
    null doc_id included; other columns are not looked at; a map without
    shuffle."""
    found = docs.select(F.col(id_col).alias("doc_id"), counts(F.col(text_col), vocabulary).alias("c"))
    return found.select("doc_id", "c.n_words", "c.n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, read_vocabulary(public_tokenizers.path("word_bpe_49k.json")))
