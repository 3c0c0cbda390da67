"""License scan by a positional index of rare words.

The index lists, for every word of the license templates, the templates and
positions where it stands, with an inverse document frequency over the
templates. A file is looked up by the highest-IDF words of key phrases that it
has: a key phrase must stand in full, so of each template that can match it has the
rarest word. Every hit fixes where the template would start, the other postings
are intersected at their positions relative to that start, and a template counts
if its mandatory key phrase stands there in full and LEAST of its weight is at its
place. The templates are a fixed list, so the index is of constant size and lives
in the expressions themselves. Built-in functions only; no shuffle.
"""
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key: tuple[str, ...]  # consecutive words of the template that must be there
    base: bool = False

    @property
    def key_at(self) -> int:
        n = len(self.key)
        return next(i for i in range(len(self.words)) if self.words[i : i + n] == self.key)


def _t(label: str, text: str, key: str = "", base: bool = False) -> Template:
    return Template(label, tuple(text.split()), tuple((key or text).split()), base)


# Phrases and labels of the base rule.
BASE = (
    _t("mit", "under the mit license", base=True),
    _t("apache-2", "apache license version 2", base=True),
    _t("cc-by-nc", "cc by nc", base=True),
)
# Beginnings and notices of well-known licenses, each with the phrase
# that must be there. (No word has a letter that a non-ASCII letter lower-cases to.)
MORE = (
    _t("gpl", "licensed under the gnu general public license version", "gnu general public license"),
    _t("lgpl", "licensed under the gnu lesser general public license version", "gnu lesser general public license"),
    _t("agpl", "licensed under the gnu affero general public license version", "gnu affero general public license"),
    _t("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    _t("bsd", "redistribution and use in source and binary forms with or without modification", "redistribution and use in source and binary forms"),
    _t("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission is hereby granted free of charge"),
    _t("apache-2", "licensed under the apache license version 2", "licensed under the apache license"),
    _t("cc-by", "creative commons attribution license", "creative commons attribution"),
    _t("mit", """
permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
the software to deal in the software without restriction including without limitation the rights to use copy modify merge
publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do
so subject to the following conditions""", "to use copy modify merge publish distribute sublicense"),
    _t("bsd", """
redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
in the documentation and or other materials provided with the distribution""", "must retain the above copyright notice"),
    _t("bsd-3", """
neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission""", "to endorse or promote products derived from this software"),
    _t("isc", """
permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided
that the above copyright notice and this permission notice appear in all copies""", "for any purpose with or without fee is hereby granted"),
    _t("apache-2", """
licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you
may obtain a copy of the license at""", "you may not use this file except in compliance with the license"),
    _t("gpl", """
this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
published by the free software foundation either version""", "under the terms of the gnu general public license"),
    _t("lgpl", """
this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
as published by the free software foundation either version""", "under the terms of the gnu lesser general public license"),
    _t("agpl", """
you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free
software foundation either version""", "under the terms of the gnu affero general public license"),
    _t("mpl-2", """
this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with
this file you can obtain one at""", "if a copy of the mpl was not distributed with this file"),
    _t("zlib", """
this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
commercial applications""", "permission is granted to anyone to use this software for any purpose"),
    _t("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "free and unencumbered software released into the public domain"),
    _t("bsl-1", "distributed under the boost software license version 1 0", "boost software license"),
    _t("epl", "made available under the terms of the eclipse public license", "eclipse public license"),
    _t("ofl", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    _t("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "has waived all copyright and related or neighboring rights"),
    _t("cc-by-sa", "creative commons attribution sharealike license", "creative commons attribution sharealike"),
)
#: Share of a template's IDF that must stand at its place, beside the key phrase.
LEAST = 0.5
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


class Index:
    def __init__(self, templates: tuple[Template, ...] = BASE + MORE):
        self.templates = templates
        df: dict[str, int] = {}
        for t in templates:
            for w in set(t.words):
                df[w] = df.get(w, 0) + 1
        self.idf = {w: round(math.log(1 + len(templates) / n), 6) for w, n in df.items()}

    def anchor(self, t: Template) -> tuple[str, int]:
        """The rarest word of the key phrase, and its position in the template."""
        at = max(range(len(t.key)), key=lambda i: (self.idf[t.key[i]], -i))
        return t.key[at], t.key_at + at

    def weights(self, t: Template) -> list[float]:
        return [self.idf[w] for w in t.words]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Index | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score, and found: the array of (label, start, share) of all templates found.

    One row per row of docs, repeated rows and null doc_id included; other
    columns aren't looked at. Null and empty texts have no words, empty labels
    and score 0. score is the largest share of a template's IDF found at its
    place, over the templates that count."""
    index = index or Index()
    anchors = sorted({index.anchor(t)[0] for t in index.templates})
    df = docs.select(F.col(id_col).alias("doc_id"), F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD), 0).alias("words"))
    word = lambda i: F.lower(F.get("words", i))
    df = df.select("doc_id", "words", F.filter(F.transform("words", lambda w, i: F.when(F.lower(w).isin(anchors), i)), lambda i: i.isNotNull()).alias("spots"))

    def places(t: Template) -> Column:
        rare, at = index.anchor(t)
        key = lambda s: _all([word(s + t.key_at + j) == F.lit(w) for j, w in enumerate(t.key)])
        starts = F.transform(F.filter("spots", lambda i: word(i) == F.lit(rare)), lambda i: i - at)
        weights = index.weights(t)
        own = F.array(*[F.struct(F.lit(j).alias("at"), F.lit(w).alias("word"), F.lit(x).alias("idf")) for j, (w, x) in enumerate(zip(t.words, weights, strict=True))])

        def share(s: Column) -> Column:
            got = F.aggregate(own, F.lit(0.0), lambda acc, p: acc + F.when(word(s + p["at"]) == p["word"], p["idf"]).otherwise(F.lit(0.0)))
            return F.round(got / sum(weights), 6)

        hits = F.transform(F.filter(starts, key), lambda s: F.struct(F.lit(t.label).alias("label"), s.alias("start"), share(s).alias("share")))
        return F.filter(hits, lambda h: h["share"] >= LEAST)

    of = lambda base: F.concat(*[places(t) for t in index.templates if t.base == base])
    df = df.select("doc_id", F.size("words").cast("long").alias("n_words"), of(True).alias("base"), of(False).alias("more"))
    df = df.select("doc_id", "n_words", "base", F.concat("base", "more").alias("found"))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda h: h["label"]))), ",")
    starts = F.transform("base", lambda h: h["start"].cast("long"))
    return df.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels("base").alias("base_labels"), labels("found").alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda h: h["share"])), F.lit(0.0)).alias("score"), "found",
    )


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return F.coalesce(out, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")


def sql(index: Index | None = None) -> str:
    """The same in DuckDB, by trying every start."""
    index = index or Index()

    def hits(t: Template) -> str:
        at = t.key_at
        key = " AND ".join(f"ws[i + {at + j + 1}] = '{w}'" for j, w in enumerate(t.key))
        got = " + ".join(f"CASE WHEN i + {j} >= 0 AND ws[i + {j + 1}] = '{w}' THEN {x}::DOUBLE ELSE 0 END" for j, (w, x) in enumerate(zip(t.words, index.weights(t), strict=True)))
        share = f"round((0.0 + {got}) / {sum(index.weights(t))!r}::DOUBLE, 6)"
        starts = f"list_filter(range(-{len(t.words)}, len(ws)), lambda i: i + {at} >= 0 AND {key})"
        return f"list_filter(list_transform({starts}, lambda i: {{'label': '{t.label}', 'start': i, 'share': {share}}}), lambda h: h.share >= {LEAST})"

    def cat(base: bool) -> str:
        out = "[]"
        for t in index.templates:
            if t.base == base:
                out = hits(t) if out == "[]" else f"list_concat({out}, {hits(t)})"
        return out

    names = lambda c: f"array_to_string(list_sort(list_distinct(list_transform({c}, lambda h: h.label))), ',')"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
h AS (SELECT doc_id, len(ws) AS n_words, {cat(True)} AS base, {cat(False)} AS more FROM w)
SELECT doc_id, n_words, len(base) AS n_base, list_min(list_transform(base, lambda h: h.start)) AS first_word,
       list_max(list_transform(base, lambda h: h.start)) AS last_word, {names('base')} AS base_labels,
       {names('list_concat(base, more)')} AS labels, coalesce(list_max(list_transform(list_concat(base, more), lambda h: h.share)), 0.0) AS score
FROM h"""
