"""License scans by diagonal voting.

Every rolling gram of GRAM words of every text is hashed and joined with the grams of the license templates, a table whose size is checked before it
is broadcast. A match at word p of the text and word q of a template votes for the diagonal p - q. A phrase template is found where one
diagonal has all of its grams. Other templates merge neighbouring diagonals whose spans lie close, which bridges inserted and dropped words.
Merged spans that hold enough of the template's grams are verified word by word on the text: the share of the template's words that stand in
the span in their order, the word that tells the license from its siblings among them, and the span's length. Of verified spans that cover
each other by more than half, the one with the highest share counts, then the one of the longest template; equal ones all count, as in a
notice that names two terms.

Null and empty texts have no words. Rows with equal doc_id, or none, are told apart by their text's hash; rows that are equal in both get
equal results. doc_id keeps its type and other columns are not read, whatever their names. A text of any length is scanned whole. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written

GRAM = 3
#: Diagonals that are no further apart than this, in spans that overlap or lie this close, are one match.
NEAR = 4
#: Share of a template's grams that a span must hold to be verified, of its words that a verified span holds, and how much longer than the
#: template it may be.
LEAST_GRAMS = 0.3
LEAST_SHARE = 0.75
MOST_STRETCH = 1.5
#: A verified span of the label must hold this word of its template.
TELLING = {"apache-2": "apache", "gpl-3": "3", "gpl-2": "2", "lgpl": "lesser", "mpl-2": "mozilla", "cc-by-nc": "noncommercial", "cc-by-sa": "sharealike"}
#: Wins over others that it overlaps, whatever their shares: the others' templates say the same but for the telling word.
FIRST = "lgpl"
#: Larger tables of template grams, and of documents with spans, are joined by a shuffle.
BROADCAST_GRAMS = BROADCAST_DOCS = 1_000_000

# Phrases that count at each place, by label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Opening sentences of common licenses, by label.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("gpl-2", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("proprietary", "All rights reserved"),
]

#: Lower-cases A-Z, keeps a-z, 0-9 and all bytes of other characters, and turns the rest into spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class GramHasher:
    """64-bit hashes of rolling grams; keeps the hashes of the words it has met."""

    most = 400_000

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(words) < GRAM:
            return np.zeros(0, np.int64)
        got = list(map(self.known.get, words))
        if None in got:
            if len(self.known) > self.most:
                self.known.clear()
            for i, x in enumerate(got):
                if x is None:
                    got[i] = self.known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        h = np.array(got, np.uint64)
        n = len(h) - GRAM + 1
        out = np.zeros(n, np.uint64)
        for k in range(GRAM):
            out = (out ^ (h[k : k + n] * _ODD[k])) * _ODD[(k + 1) % GRAM]
            out ^= out >> np.uint64(29)
        return out.view(np.int64)


#: Template number: label, words, and whether it is a phrase.
ALL_TEMPLATES = [(label, words_of(text), True) for text, label in PHRASES.items()] + [(label, words_of(text), False) for label, text in TEMPLATES]


def telling(number: int) -> bytes | None:
    """The word that a span of the template must have."""
    label, _, phrase = ALL_TEMPLATES[number]
    return TELLING[label].encode() if label in TELLING and not phrase else None


def template_grams(spark: SparkSession) -> DataFrame:
    """template, phrase, n_grams, q and gram of all templates."""
    hasher, rows = GramHasher(), []
    for number, (_, words, phrase) in enumerate(ALL_TEMPLATES):
        grams = hasher(words).tolist()
        rows += [(number, phrase, len(grams), q, g) for q, g in enumerate(grams)]
    return spark.createDataFrame(rows, "template int, phrase boolean, n_grams int, q int, gram long")


_GRAMS = "_hash long, grams array<bigint>"


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = GramHasher()
    for batch in batches:
        for at in range(0, len(batch), 500):
            part = batch.slice(at, 500)
            grams = [hasher(words_of(text.as_py())) for text in part.column("text")]
            ends = np.cumsum([0, *map(len, grams)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*grams, np.zeros(0, np.int64)]), pa.int64()))
            columns = [part.column("doc_id"), part.column("_hash"), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_hash", "grams"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = pa.array([len(words_of(text.as_py())) for text in batch.column("text")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_hash"), n], names=["doc_id", "_hash", "n_words"])


def votes(rows: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, _hash, template, phrase, n_grams, diagonal, and the template positions qs that voted."""
    grams = rows.mapInArrow(_grams, f"doc_id {dict(rows.dtypes)['doc_id']}, {_GRAMS}")
    rolled = grams.select("doc_id", "_hash", F.posexplode("grams").alias("p", "gram"))
    small = F.broadcast(templates) if templates.count() <= BROADCAST_GRAMS else templates
    matched = rolled.join(small, "gram").withColumn("diagonal", F.col("p") - F.col("q"))
    return matched.groupBy("doc_id", "_hash", "template", "phrase", "n_grams", "diagonal").agg(F.collect_set("q").alias("qs"))


def common_words(words: list[bytes], span: list[bytes]) -> int:
    """The most words of a template that stand in a span in their order."""
    best = [0] * (len(span) + 1)
    for w in words:
        diagonal = 0
        for k, x in enumerate(span, 1):
            diagonal, best[k] = best[k], diagonal + 1 if w == x else max(best[k], best[k - 1])
    return best[-1]


def verified(words: list[bytes], found: list[dict]) -> list[dict]:
    """Of the spans (template, start, end) of one text those that its words bear out, with label, phrase and share."""
    kept = []
    for s in found:
        label, template, phrase = ALL_TEMPLATES[s["template"]]
        span, word = words[s["start"] : s["end"]], telling(s["template"])
        share = float(span == template) if phrase else common_words(template, span) / len(template)
        if share >= LEAST_SHARE and (word is None or word in span):
            kept.append({"label": label, "phrase": phrase, "start": s["start"], "end": s["end"], "share": share, "n_words": len(template)})
    return kept


def strongest(spans: list[dict]) -> list[dict]:
    """The spans of one text without those that a stronger one covers by more than half of the shorter."""
    rank = lambda s: (s["label"] == FIRST, s["share"], s["n_words"])
    kept, run, reach = [], [], -1
    for s in [*sorted(spans, key=lambda s: (s["start"], s["end"])), None]:
        if run and (s is None or s["start"] >= reach):  # a run of spans that overlap one another ends
            won = []
            for x in sorted(run, key=rank, reverse=True):
                covers = (w for w in won if 2 * (min(x["end"], w["end"]) - max(x["start"], w["start"])) > min(x["end"] - x["start"], w["end"] - w["start"]))
                if all(rank(w) == rank(x) for w in covers):
                    won.append(x)
            kept += won
            run, reach = [], -1
        if s is not None:
            run.append(s)
            reach = max(reach, s["end"])
    return kept


_SPANS = T.ArrayType(T.StructType().add("label", "string").add("phrase", "boolean").add("start", "integer").add("end", "integer").add("share", "double"))


@F.pandas_udf(_SPANS)
def _judged(text: pd.Series, found: pd.Series) -> pd.Series:
    """Phrases as they are found, and the strongest of the other spans."""
    out = []
    for t, spans_ in zip(text, found, strict=True):
        good = verified(words_of(t), list(spans_))
        kept = [s for s in good if s["phrase"]] + strongest([s for s in good if not s["phrase"]])
        out.append([{k: s[k] for k in ("label", "phrase", "start", "end", "share")} for s in kept])
    return pd.Series(out)


def candidates(voted: DataFrame) -> DataFrame:
    """doc_id, _hash, template, start and end (in words) of the spans to verify."""
    sized = voted.withColumns({"start": F.col("diagonal") + F.array_min("qs"), "end": F.col("diagonal") + F.array_max("qs") + GRAM})
    sized = sized.withColumn("whole", F.size("qs") == F.col("n_grams"))
    columns = ["doc_id", "_hash", "template", "start", "end"]
    keys = ["doc_id", "_hash", "template"]
    parts = sized.where(~F.col("phrase") & ~F.col("whole"))
    along = Window.partitionBy(*keys).orderBy("diagonal")
    turned = F.col("diagonal") - F.lag("diagonal").over(along) > NEAR * F.lit(2)
    parts = parts.withColumn("band", F.sum(F.coalesce(turned, F.lit(True)).cast("int")).over(along))
    order = Window.partitionBy(*keys, "band").orderBy("start", "diagonal")
    last_end = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = parts.withColumn("new", F.coalesce(F.col("start") > last_end + NEAR, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(order))
    merged = islands.groupBy(*keys, "n_grams", "band", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("held"))
    likely = merged.where((F.col("held") >= LEAST_GRAMS * F.col("n_grams")) & (F.col("end") - F.col("start") <= MOST_STRETCH * (F.col("n_grams") + GRAM - 1)))
    return sized.where("whole").select(*columns).unionByName(likely.select(*columns))


def spans(rows: DataFrame) -> DataFrame:
    """doc_id, _hash, label, phrase, start, end (in words) and share of every verified match in rows (doc_id, _hash, text)."""
    voted = written(votes(rows, template_grams(rows.sparkSession)))
    found = written(candidates(voted).groupBy("doc_id", "_hash").agg(F.collect_list(F.struct("template", "start", "end")).alias("found")))
    few = found.count() <= BROADCAST_DOCS
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d._hash") == F.col("f._hash"))
    keys = found.select("doc_id", "_hash").alias("f")
    texts = rows.alias("d").join(F.broadcast(keys) if few else keys, same, "left_semi").dropDuplicates(["doc_id", "_hash"])
    judged = texts.alias("d").join(found.alias("f"), same).select("d.doc_id", "d._hash", _judged("d.text", "f.found").alias("kept"))
    return judged.select("doc_id", "_hash", F.inline("kept"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    found = spans(rows)
    base = F.when(F.col("phrase"), F.col("start"))
    labels = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per_doc = found.groupBy("doc_id", "_hash").agg(
        F.count(base).alias("n_base"), F.min(base).cast("long").alias("first_word"), F.max(base).cast("long").alias("last_word"),
        labels(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), labels("label").alias("labels"), F.max("share").alias("score"))
    per_doc = written(per_doc)
    all_rows = rows.mapInArrow(_word_counts, f"doc_id {dict(rows.dtypes)['doc_id']}, _hash long, n_words long").alias("d")
    small = F.broadcast(per_doc) if per_doc.count() <= BROADCAST_DOCS else per_doc
    joined = all_rows.join(small.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d._hash") == F.col("f._hash")), "left")
    none = F.lit("")
    return joined.select("d.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
