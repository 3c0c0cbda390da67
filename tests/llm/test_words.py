"""Word hashes of many texts at once against Python's own splitting."""
import random

import numpy as np
import pyarrow as pa

from tessera.llm import words


def check(texts, array):
    h, n = words.counted(array)
    want = [(t or "").encode().lower().split() for t in texts]
    assert n.tolist() == [len(w) for w in want]
    known: dict[bytes, int] = {}
    for word, x in zip((w for t in want for w in t), h.tolist(), strict=True):
        assert known.setdefault(word, x) == x
    assert len(set(known.values())) == len(known)


def test_words_of_odd_texts():
    rng = random.Random(1)
    letters = ["a", "B", "b", "é", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "ß", "漢", "-", " "]
    texts = [None if rng.random() < 0.1 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    check(texts, pa.array(texts))
    check(texts[7:900], pa.array(texts)[7:900])
    check([None, ""], pa.array([None, ""], pa.string()))
    assert words.counted(pa.array([], pa.string()))[1].tolist() == []


def test_words_longer_than_a_block():
    texts = ["x" * (3 * words.BLOCK) + " y", "q " + "Z" * words.BLOCK + " w", "ab " * (words.BLOCK // 2), "q"]
    check(texts, pa.array(texts))


def test_parts_cover_all_rows():
    texts = pa.array(["a" * k for k in (0, 5, 100, 3, 0, 7)])
    got = list(words.parts(texts, 8))
    assert [x for _, p in got for x in p.to_pylist()] == texts.to_pylist()
    assert [at for at, _ in got] == np.cumsum([0, *(len(p) for _, p in got)])[:-1].tolist()
