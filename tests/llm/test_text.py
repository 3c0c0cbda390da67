"""BPE, token counts, language ID, language models, licenses, secrets, leaks."""
import collections
import hashlib
import json
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, language_id, licenses, lm_score, secrets, token_counts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def enc():
    return bpe.encoding(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


def test_bpe_equals_the_library(odd, enc):
    got = bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()
    texts = collections.defaultdict(set)
    for r in odd.collect():
        texts[r["doc_id"]].add(r["text"] or "")
    assert len(got) == odd.count()
    for r in got:
        assert bytes(r["decoded"]).decode() in texts[r["doc_id"]]
        assert any(list(r["token_ids"]) == enc.encode_ordinary(t) for t in texts[r["doc_id"]])
    for r in bpe.summary(bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN)).where("doc_id = 10").collect():
        ids = enc.encode_ordinary("one")
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and r["n_tokens"] == len(ids)


def test_bpe_columns(odd, enc):
    ids = odd.select("text", bpe.encode(F.col("text"), RANKS, public_tokenizers.PATTERN).alias("ids"))
    for r in ids.select("text", "ids", bpe.decode(F.col("ids"), RANKS, public_tokenizers.PATTERN).alias("back")).collect():
        assert list(r["ids"]) == enc.encode_ordinary(r["text"] or "") and bytes(r["back"]).decode() == (r["text"] or "")


def test_cut_texts_encode_as_whole_ones(enc):
    rng = random.Random(2)
    parts = ["word", "  ", "\n\n ", "don't", "'s", "12", "!!", "é", " ", "　", "\x1c", "\x85", "\t", " x", "<|endoftext|>"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))
        assert bpe.encode_text(enc, text, size=5) == enc.encode_ordinary(text)
        assert "".join(bpe.pieces(text, 5)) == text


def greedy(pieces, word):
    """(count) by trying the longest piece first."""
    symbols, n = (*word, token_counts.END), 0
    while symbols:
        for k in range(len(symbols), 0, -1):
            if symbols[:k] in pieces:
                symbols, n = symbols[k:], n + 1
                break
        else:
            return 1
    return n


def test_automaton_equals_greedy_matching():
    rng = random.Random(1)
    for _ in range(60):
        pieces = {tuple(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) + ((token_counts.END,) if rng.random() < 0.5 else ()) for _ in range(rng.randint(1, 14))}
        pieces |= {(token_counts.END,)} if rng.random() < 0.7 else set()
        auto = token_counts.Automaton(pieces)
        for _ in range(80):
            word = bytes(rng.choice(b"abcd" if rng.random() < 0.1 else b"abc") for _ in range(rng.randint(1, 9)))
            assert auto.count(word) == greedy(pieces, word), (pieces, word)


def test_token_counts(odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    vocab = token_counts.read_vocabulary(path)
    assert 49_000 <= len(vocab) <= len(json.load(open(path))["model"]["vocab"])
    pieces = set(vocab)
    got = token_counts.token_counts(odd, vocab).collect()
    assert len(got) == odd.count()
    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    for r in got:
        words = [w for c in (texts[r["doc_id"]] or "").lower().split() for w in re.findall(r"[^\W\d_]+|\d|(?:[^\w\s]|_)+", c)]
        assert r["n_words"] == len(words)
        if len(texts[r["doc_id"]] or "") < 1000:
            assert r["n_tokens"] == sum(greedy(pieces, w.encode()) for w in words)


def sentences(lang, n, rng):
    parts = {"en": ["the", "and", "ing", "ther", "on"], "de": ["der", "sch", "ung", "ein", "ü"], "es": ["ción", "que", "los", "ñ", "el"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_language_accuracy_and_oddities(spark, odd):
    rng = random.Random(3)
    rows = [(i, sentences(lang, rng.randint(5, 300), rng), lang) for i, lang in enumerate(rng.choice(["en", "de", "es"]) for _ in range(400))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.identify(df).join(df, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    test = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == r["lang"] for r in test]) > 0.95 and all(0 <= r["score"] <= 1 for r in got)
    # What a row says of itself is no input.
    other = language_id.identify(df.withColumn("lang", F.when(language_id.held_out(), F.lit("xx")).otherwise(F.col("lang"))))
    assert sorted(map(tuple, other.collect())) == sorted((r["doc_id"], r["held_out"], r["lang_pred"], r["score"]) for r in got)
    found = {r["doc_id"]: r for r in language_id.identify(odd).collect()}
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (3, 4, 5, 8)) and not found[None]["held_out"]
    left = language_id.known_language(odd)
    assert left.columns == odd.columns and not {3, 4, 5, 8} & {r["doc_id"] for r in left.collect()}


def test_windows_cover_whole_texts():
    text = bytes(range(1, 251)) * 7
    w = language_id.windows(text)
    flat = w[:, : language_id.WINDOW].reshape(-1)
    assert flat[flat != language_id.PAD].tolist() == list(text)


def base_scores(rows):
    tokens = {k: [*(t or "").encode().lower().split(), None] for k, t in rows}
    learn = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 != 1]
    c = collections.Counter(w for k in learn for w in tokens[k])
    n, v = sum(c.values()), len(c)
    return {k: (len(w), sum(c[t] > 0 for t in w), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in w)) for k, w in tokens.items()}


@pytest.mark.parametrize("most_words", [lm_score.MOST_WORDS, 0])
def test_base_scores(spark, most_words):
    rng = random.Random(6)
    rows = [(i, None if i % 17 == 0 else sentences("en", rng.randint(0, 80), rng)) for i in range(120)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS h")
    got = lm_score.scores(df, F.crc32(F.col("doc_id").cast("string")) % 5 != 1, most_words=most_words).collect()
    want = base_scores(rows + rows[:3])
    assert len(got) == 123
    for r in got:
        w = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:3] and abs(r["base_score"] - w[3]) < 1e-6 and r["score"] < 0


def brute_score(tokens, ones, twos, total):
    """log10 probability of a token list by counts of levels: a count c with
    2**(q - 1) <= c < 2**q is read as the middle of that range."""
    level = lambda c: (3 * 2.0 ** (c.bit_length() - 1) - 1) / 2 if c else 0.0
    out, before = 0.0, None
    for t in tokens:
        history, pair, alone = level(ones[before]), level(twos[before, t]), (level(ones[t]) + 0.5) / total
        p = 0.7 * pair / max(history, pair, 1) + 0.3 * alone if history else alone
        out, before = out + math.log10(min(p, 1)), t
    return out


def test_scores_are_those_of_the_levels(spark):
    """The filter is large enough here for no false positive among these n-grams."""
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{min(int(rng.paretovariate(0.7)), 60)}" for _ in range(rng.randint(0, 30)))) for i in range(60)]
    learn = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    ones, twos = collections.Counter(), collections.Counter()
    for text in learn:
        tokens = [*text.split(), None]
        ones.update(tokens)
        twos.update(zip([None, *tokens], tokens, strict=False))
    total = sum(ones.values()) + 0.5 * (len(ones) + 1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm_score.scores(df, F.crc32(F.col("doc_id").cast("string")) % 5 != 1).collect()}
    assert len(got) == 60
    for i, text in rows:
        assert abs(got[i] - brute_score([*text.split(), None], ones, twos, total)) < 1e-9


@pytest.mark.parametrize("most_words", [lm_score.MOST_WORDS, 0])
def test_scores_do_not_depend_on_what_is_broadcast_at_once(spark, monkeypatch, most_words):
    rng = random.Random(7)
    rows = [(i, None if i % 97 == 0 else " ".join(f"w{rng.randrange(5000)}" for _ in range(80))) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learn = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    want = {r["doc_id"]: r for r in lm_score.scores(df, learn, most_words=most_words).collect()}
    monkeypatch.setattr(lm_score, "MOST_BITS", lm_score.SEGMENT)
    got = {r["doc_id"]: r for r in lm_score.scores(df, learn, most_words=most_words).collect()}
    assert len(got) == 4000 and got.keys() == want.keys()
    for k, r in got.items():
        assert r["n_tokens"] == want[k]["n_tokens"] and r["n_known"] == want[k]["n_known"]
        assert abs(r["score"] - want[k]["score"]) < 1e-9 and abs(r["base_score"] - want[k]["base_score"]) < 1e-9


def test_passes_write_no_texts_and_score_every_row(spark, monkeypatch):
    """Several passes over the filter and the words; rows that repeat and null ids."""
    rows = [(i % 50 or None, " ".join(f"w{(i * j) % 700}" for j in range(i % 60))) for i in range(300)]
    rows += [*rows[:20], (None, None), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    learn = F.col("doc_id") % 5 != 1
    told = lambda most: sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in lm_score.scores(df, learn, most_words=most).collect())
    want, keep, wrote = told(lm_score.MOST_WORDS), lm_score.Scratch.keep, []

    def seen(self, part, name, **counts):
        wrote.append((name, part.columns))
        return keep(self, part, name, **counts)

    monkeypatch.setattr(lm_score.Scratch, "keep", seen)
    monkeypatch.setattr(lm_score, "LEAST_WORDS", 256, raising=False)
    assert told(0) == want and len(want) == 322
    assert sum(name == "levels" for name, _ in wrote) > 1 and not any("text" in columns for _, columns in wrote)


def test_log_filter_reads_counts_back(spark):
    rng = np.random.default_rng(3)
    h, n = rng.integers(0, 2**63, 3000, dtype=np.uint64), 2 ** rng.integers(0, 12, 3000)
    df = spark.createDataFrame([(1, int(x), int(k)) for x, k in zip(h.view(np.int64), n, strict=True)], "order byte, h long, n long")
    model = lm_score.build_filter(df, int(sum(int(k).bit_length() for k in n)))
    levels = model.levels(h, 1)
    want = np.array([int(k).bit_length() for k in n])
    assert (levels >= want).all() and (levels == want).mean() > 0.95
    assert (model.levels(rng.integers(0, 2**63, 3000, dtype=np.uint64), 1) > 0).mean() < 0.06


def test_licenses_brute_force_and_spacing(spark, odd):
    text = "x Under THE mit-license; apache\n\nLicense, version 2.0 cc by nc sa. under the mit licenses. Under the éMIT license"
    df = spark.createDataFrame([(1, text), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "mit mit license under the mit")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (3, 1, 10, "apache-2,cc-by-nc,mit")
    assert got[2]["labels"] == "gpl" and got[2]["base_labels"] == "" and 0 < got[2]["score"] <= 1
    assert got[3]["n_base"] == 0 and got[3]["first_word"] is None and got[3]["score"] == 0
    found = licenses.scan(odd)
    assert found.count() == odd.count() and found.where("doc_id = 11").first()["base_labels"] == "mit"


def test_license_texts_with_changes(spark):
    """A notice counts while its key phrase stands and half of its weight is in place."""
    notice = next(t for t in licenses.MORE if t.label == "isc")
    words = list(notice.words)
    cut = " ".join(words[notice.key_at - 2 :])
    changed = " ".join(w if i in range(notice.key_at, notice.key_at + len(notice.key)) or i % 4 else "other" for i, w in enumerate(words))
    broken = " ".join(w for w in words if w != "fee")
    df = spark.createDataFrame([(0, "x " + " ".join(words).upper() + " y"), (1, cut), (2, changed), (3, broken), (4, " ".join(notice.key))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert got[0]["labels"] == "isc" and got[0]["score"] == 1.0 and [(f["label"], f["start"]) for f in got[0]["found"]] == [("isc", 1)]
    assert got[1]["labels"] == got[2]["labels"] == "isc" and 0.5 <= got[2]["score"] < 1
    assert got[1]["found"][0]["start"] == 2 - notice.key_at
    assert got[3]["labels"] == "" and got[4]["labels"] == "" and got[4]["score"] == 0


def brute_secrets(text):
    out = []
    for kind, rx, group, least in secrets.KINDS:
        rx = rx.replace("(?i:password|passwd|secret|token|api_?key)", "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]")
        out += [(m.start(), kind, m.end()) for m in re.finditer(rx, text or "") if len(m[group]) >= least]
    return out


def test_secrets_brute_force(spark, odd):
    rng = random.Random(5)
    parts = ["password", "TOKEN", "api_key", "Secret", " = ", ":", "='", '"', "abcdef123", "ab", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "é", "\U0001f600", " ", "\n", "-", "token: abc"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))), f"s{i % 5}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in secrets.scan(df).collect()}
    order = [k for k, *_ in secrets.KINDS]
    for i, t, _ in rows:
        want = [f"{k}:{a}:{b}" for a, k, b in sorted(brute_secrets(t), key=lambda x: (x[0], order.index(x[1])))]
        assert list(got[i]["base_spans"]) == want and [s for s in got[i]["spans"] if not s.startswith("live")] == want
    found = secrets.scan(odd)
    assert found.count() == odd.count()
    row = found.where("doc_id = 11").first()
    assert (row["n_assign"], row["n_access"]) == (1, 1) and sum(s.startswith("live") for s in row["spans"]) == 2


def test_owners_tell_examples_from_live(spark):
    rows = [(i, "token = 'example123'", f"o{i}") for i in range(5)] + [(9, "token = 'private456'", "o1"), (9, "token = 'private456'", "o1")]
    got = {r["doc_id"]: list(r["spans"]) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[0] == ["assign:0:19"] and got[9] == ["assign:0:19", "live:0:19"]


def test_repositories_of_one_owner_are_not_examples(spark):
    rows = [(i, "token = 'everywhere1'", f"acme/r{i}") for i in range(6)] + [(10 + i, "token = 'copied-text'", f"o{i}/r") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: any(s.startswith("live") for s in r["spans"]) for r in secrets.scan(df).collect()}
    assert all(got[i] for i in range(6)) and not any(got[10 + i] for i in range(3))


def test_a_text_of_very_many_matches(spark):
    n = 20_000
    df = spark.createDataFrame([(1, "token = abcdef123 and " * n + "token: short" + " token=x" * 3, "a")], "doc_id long, text string, source string")
    begun = time.time()
    row = secrets.scan(df).first()
    took = time.time() - begun
    assert row["n_assign"] == n and list(row["base_spans"])[:2] == ["assign:0:17", "assign:22:39"] and row["base_spans"][-1] == f"assign:{22 * (n - 1)}:{22 * (n - 1) + 17}"
    assert took < 20, took


def test_leaks_and_paraphrases(spark, odd):
    rng = random.Random(7)
    vocab = [f"{a}{b}" for a in "bcdfghjkl" for b in ("a", "en", "ist", "or", "um", "y")]
    zipf = lambda n: [vocab[min(int(rng.paretovariate(0.6)) - 1, len(vocab) - 1)] if rng.random() < 0.3 else rng.choice(vocab) + rng.choice(vocab) for _ in range(n)]
    items = [(i, zipf(rng.randint(15, 58))) for i in range(12)]
    docs, want = [], set()
    for d in range(120):
        words = zipf(rng.randint(30, 300))
        if d % 4 == 0:
            i, passage = items[d // 4 % 12]
            passage = list(passage)
            if d % 8 == 0:  # every tenth word is another
                for j in range(5, len(passage), 10):
                    passage[j] = "other" + str(j)
            at = rng.randint(0, len(words))
            words[at:at] = passage
            want.add((d, i))
        docs.append((d, " ".join(words).capitalize() + "."))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(98, None), (99, "too short"), (None, "x " * 30)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, bench).collect()}
    assert len(want - got) <= 1 and not got - want
    left = decontaminate.drop_leaks(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count()


def brute_leaks(docs, items, verbatim=0.8, paraphrase=0.6):
    """(doc, item) by the longest common subsequence of each passage with every
    stretch of a text that is as long as the passage and half a step to either side."""
    memo, out = decontaminate.WordCodes(), set()
    for d, text in docs:
        codes = decontaminate.word_codes(text, memo)
        for i, item in items:
            part = decontaminate.word_codes(item, memo)
            tail = part[-max(2, len(part) // 4) :]
            for at in range(max(1, len(codes) - len(part) + 1)):
                region = codes[max(0, at - 2) : at + len(part) + 2]
                if len(np.intersect1d(region, part)) < paraphrase * len(set(part.tolist())) * 0.9:
                    continue
                share = decontaminate.lcs(part, region) / len(part)
                if share >= verbatim or (share >= paraphrase and decontaminate.lcs(tail, region) >= 0.8 * len(tail)):
                    out.add((d, i))
                    break
    return out


def test_recall_of_paraphrases_and_short_items(spark):
    """Items of 5 to 58 words, in texts as they are or with a fifth of the words
    changed or left out."""
    rng = random.Random(12)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    words = lambda n: [rng.choice(vocab[:20] if rng.random() < 0.25 else vocab) for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate([5, 6, 8, 10, 12, 15, 20, 23, 24, 30, 36, 44, 58] * 2)]
    docs = []
    for d in range(260):
        text, (_, item) = words(rng.randint(20, 200)), items[d % len(items)]
        passage = item.split()
        if d % 3 == 1:
            passage = [w if rng.random() > 0.2 else "changed" for w in passage]
        elif d % 3 == 2:
            passage = [w for w in passage if rng.random() > 0.2]
        at = rng.randint(0, len(text))
        docs.append((d, " ".join(text[:at] + passage + text[at:])))
    want = brute_leaks(docs, items)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) > 150 and len(want & got) >= 0.95 * len(want), (len(want), len(want & got))
    # What is found beyond is found in a stretch that is longer by a step.
    assert len(got - want) <= 0.05 * len(want)


def test_leaks_in_long_texts_and_of_few_words(spark):
    rng = random.Random(13)
    words = lambda n: [f"x{rng.randrange(5000)}" for _ in range(n)]
    item = words(40)
    at = 2 * decontaminate.PIECE - 17
    long = words(3 * decontaminate.PIECE)
    long[at : at + 40] = item
    docs = [(1, " ".join(long)), (2, "so he said Open, Sesame! and left"), (3, "open the door sesame"), (4, None), (5, "")]
    items = [(1, " ".join(item)), (2, "open sesame"), (3, "..."), (4, "")]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 1), (2, 2)}
    first = next(r["first_word"] for r in got if r["doc_id"] == 1)
    assert at - 2 * decontaminate.STEP <= first <= at


def test_lcs():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(1, 6, rng.integers(1, 30)), rng.integers(1, 6, rng.integers(1, 40))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        assert decontaminate.lcs(a, b) == t[-1, -1]
