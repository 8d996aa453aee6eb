"""License scan by diagonal voting (operator 13).

Templates are short phrases, found word for word, and license texts, found with
words put in, left out or changed. Texts are lower-cased (A-Z) and cut into
words (runs of ASCII letters and digits and of other characters beyond ASCII).

All rolling hashes of k words of all texts are joined with the places of the
same k words in the templates (k = PHRASE_K for phrases, TEXT_K for texts). A
hit lies on the diagonal place in the text - place in the template. Hits are
counted by text, template and diagonal. Diagonals of a license text at most
DRIFT apart are merged: words put in or left out shift what follows them. What
has enough votes is verified on the words themselves: a phrase must stand there
whole; of a license text, VERIFIED of its words or more must stand in the span
in their order.

Scale: texts are read twice by Arrow maps and not shuffled. Of the first pass
only hits are left after the join with the templates, which is broadcast up to
TEMPLATE_WORDS words and a shuffle join beyond. Votes are partial sums by
(document key, template, diagonal). The second pass hands on the texts of
documents with candidates alone, found by a bit array of bounded size; these and
a narrow row for every other document meet the candidates by key. What is
gathered by key is bounded by the text's own length.

A null text is empty. Rows that are equal in id and text give equal rows, one
each; null ids are ids like others. A very long text is hashed in parts. Extra
columns are kept by `scan`, under any name but those of the added ones. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .keyfilter import KeyFilter
from .shared import bound_batches, keep, parts, schema_with, unused
from .wordhash import Words, blocks, shingle_hashes

PHRASE_K, TEXT_K = 2, 4
#: Words put in or left out between two parts of a license text.
DRIFT = 8
#: Of 100 of a text's rolling hashes, the votes that make a candidate; of its words, the share that verifies it.
VOTES, VERIFIED = 30, 0.75
#: Templates of so many words in all are broadcast, about 40 bytes each.
TEMPLATE_WORDS = 200_000
#: What a phrase by itself says about a document.
PHRASE_SCORE = 0.5
#: Words of a text that make one row of hashes.
PART_WORDS = 1 << 15


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    #: Phrases are found word for word.
    phrase: bool = False


#: Phrases of the base and their labels.
BASE = (
    Template("mit", "mit license", True),
    Template("apache", "apache license", True),
    Template("gpl", "general public license", True),
)
#: Notices and openings of public licenses.
TEXTS = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file"),
    Template("cc", "This work is licensed under a Creative Commons Attribution International License"),
    Template("cc", "Licensed under CC BY-NC 4.0"),
    Template("cc", "Licensed under CC BY-SA 4.0"),
    Template("cc", "Licensed under CC BY 4.0"),
)
_WORD = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalnum())
_FOLD = bytes(c + 32 if ord("A") <= c <= ord("Z") else c if c in _WORD else 0x20 for c in range(256))
_SPAN = "struct<label:string,base:boolean,start:int,end:int,share:double>"


def folded(text: str | None) -> bytes:
    """The text's words between spaces."""
    return (text or "").encode().translate(_FOLD)


def words_of(text: str | None) -> list[bytes]:
    return folded(text).split()


def _hashes(words: np.ndarray) -> np.ndarray:
    """For each word, the hash of the PHRASE_K and of the TEXT_K words from it on, one after the other; 0 where the words end before."""
    out = np.zeros((len(words), 2), np.uint64)
    for j, k in enumerate((PHRASE_K, TEXT_K)):
        own = shingle_hashes(words, k)
        out[: len(own), j] = own
    return out.ravel()


def places(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """h, template, at: where the rolling hashes stand in the templates."""
    rows = []
    for number, template in enumerate(templates):
        k = PHRASE_K if template.phrase else TEXT_K
        own = shingle_hashes(Words([folded(template.text)]).hashes, k)
        if not len(own):
            raise ValueError(f"a template of fewer than {k} words: {template.text}")
        rows.extend((int(h), number, at) for at, h in enumerate(own.view(np.int64)))
    found = spark.createDataFrame(rows, "h long, template int, at int")
    return F.broadcast(found) if len(rows) <= TEMPLATE_WORDS else found


def _keys(key: str, text: str) -> list[Column]:
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.col(key).alias("id"), F.xxhash64(whole).alias("a"), F.xxhash64(F.lit(1), whole).alias("b")]


def _rolling(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, a, b, first, hashes: the rolling hashes of every text, by parts of PART_WORDS words from `first` on."""
    rows = docs.select(*_keys(key, text), F.col(text).alias("text")).where(F.col("text") != "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = [folded(t) for t in batch.column(3).to_pylist()]
            for begin, end in blocks(texts):
                block = Words(texts[begin:end])
                row, first, own = [], [], []
                for i in range(end - begin):
                    words = block.hashes[block.offsets[i] : block.offsets[i + 1]]
                    every = _hashes(words)
                    for at in range(0, len(words), PART_WORDS):
                        row.append(begin + i)
                        first.append(at)
                        own.append(every[2 * at : 2 * (at + PART_WORDS)])
                edges = np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int32)
                flat = np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64)
                take = pa.array(row, pa.int64())
                columns = [batch.column(k).take(take) for k in range(3)]
                columns += [pa.array(first, pa.int32()), pa.ListArray.from_arrays(pa.array(edges), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "a", "b", "first", "hashes"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, a long, b long, first int, hashes array<long>")


def votes(docs: DataFrame, templates: tuple[Template, ...] = BASE + TEXTS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id, a, b, template, diagonal, votes: hits of every text on every diagonal."""
    every = _rolling(docs, key, text).select("id", "a", "b", "first", F.posexplode("hashes").alias("place", "h"))
    hits = every.join(places(docs.sparkSession, templates), "h")
    diagonal = F.col("first") + F.shiftright("place", 1) - F.col("at")
    return hits.groupBy("id", "a", "b", "template", diagonal.alias("diagonal")).agg(F.count("*").alias("votes"))


def candidates(voted: DataFrame, templates: tuple[Template, ...] = BASE + TEXTS) -> DataFrame:
    """id, a, b, template, low, high: diagonals, neighbouring ones merged for license texts, with enough votes."""
    needs = [(n, t.phrase, len(words_of(t.text)) - (PHRASE_K if t.phrase else TEXT_K) + 1) for n, t in enumerate(templates)]
    least = F.element_at(F.create_map(*[F.lit(x) for n, phrase, grams in needs for x in (n, grams if phrase else max(1, -(-grams * VOTES // 100)))]), F.col("template"))
    phrases = [n for n, phrase, _ in needs if phrase]
    drift = F.when(F.col("template").isin(phrases), 0).otherwise(DRIFT)
    own = Window.partitionBy("id", "a", "b", "template").orderBy("diagonal")
    opens = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(own) > drift).cast("int"), F.lit(1))
    merged = voted.withColumn("opens", opens).withColumn("run", F.sum("opens").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy("id", "a", "b", "template", "run").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    return merged.where(F.col("votes") >= least).select("id", "a", "b", "template", "low", "high")


def verified(words: list[bytes], template: Template, wanted: list[bytes], low: int, high: int) -> list[tuple[int, int, float]]:
    """(first word, end, share of the template's words) of what stands on these diagonals.

    Of merged diagonals of more than the template's length, which many places make together, each stretch of that length is looked at.
    """
    if template.phrase:
        return [(low, low + len(wanted), 1.0)] if low >= 0 and words[low : low + len(wanted)] == wanted else []
    found: list[tuple[int, int, float]] = []
    step = len(wanted)
    for diagonal in range(low, high + 1, step):
        begin = max(0, diagonal, found[-1][1] if found else 0)
        part = words[begin : min(high, diagonal + step) + len(wanted)]
        same = [m for m in SequenceMatcher(None, wanted, part, autojunk=False).get_matching_blocks() if m.size]
        share = sum(m.size for m in same) / len(wanted)
        if share >= VERIFIED:
            found.append((begin + same[0].b, begin + same[-1].b + same[-1].size, share))
    return found


def _spans(text: str | None, asked: list[dict], templates: tuple[Template, ...], wanted: list[list[bytes]]) -> list[dict]:
    words = words_of(text)
    out = []
    for c in asked:
        template = templates[c["template"]]
        for start, end, share in verified(words, template, wanted[c["template"]], c["low"], c["high"]):
            out.append({"label": template.label, "base": template.phrase, "start": start, "end": end, "share": share})
    return sorted(out, key=lambda s: (s["start"], s["end"], s["label"], not s["base"]))


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + TEXTS, key: str = "doc_id", text: str = "text", n_words: str = "n_words", spans: str = "spans", carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` of docs (all, if none are named) with `n_words` and `spans`: array<struct<label, base, start, end, share>> in words, by start.

    Carried columns meet the candidates by key: do not carry the text where it isn't asked for.
    Arrow batches of the session are bounded (see `bound_batches`).
    """
    bound_batches(docs.sparkSession)
    carry = [c for c in (docs.columns if carry is None else carry) if c not in (n_words, spans)]
    docs = docs.drop(n_words, spans)
    of_key = candidates(votes(docs, templates, key, text), templates).groupBy("id", "a", "b").agg(F.collect_list(F.struct("template", "low", "high")).alias("asked"))
    # Few narrow rows: a file for each core, not for each partition of the shuffle.
    found = keep(of_key.repartition(docs.sparkSession.sparkContext.defaultParallelism), "license-candidates")
    known = docs.sparkSession.sparkContext.broadcast(KeyFilter.of(found.select("a"), "a"))  # bounded by keyfilter.MOST_BITS
    i, a, b, whole, asked = unused([*docs.columns, n_words, spans], "i", "a", "b", "whole", "asked")
    named = docs.select(*[F.col(f"`{c}`") for c in carry], *[c.alias(n) for c, n in zip(_keys(key, text), (i, a, b), strict=True)], F.col(text).alias(whole))
    wanted = [words_of(t.text) for t in templates]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            has = known.value.has(batch.column(batch.num_columns - 3).to_numpy().view(np.uint64))
            left = pa.array([t if h else None for t, h in zip(texts, has, strict=True)], pa.string())
            many = pa.array([len(words_of(t)) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], left, many], names=[*batch.schema.names, n_words])

    rows = named.mapInArrow(counted, schema_with(named, **{n_words: "long"}))
    same = F.col(f"rows.{i}").eqNullSafe(F.col("found.id")) & (F.col(f"rows.{a}") == F.col("found.a")) & (F.col(f"rows.{b}") == F.col("found.b"))
    met = rows.alias("rows").join(found.alias("found"), same, "left").select("rows.*", F.col("found.asked").alias(asked))

    @F.arrow_udf(f"array<{_SPAN}>")
    def checked(columns: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct({"label": pa.string(), "base": pa.bool_(), "start": pa.int32(), "end": pa.int32(), "share": pa.float64()}))
        for texts, cands in columns:
            yield pa.array([_spans(t, c, templates, wanted) if c else [] for t, c in zip(texts.to_pylist(), cands.to_pylist(), strict=True)], kind)

    return met.withColumn(spans, checked(F.col(whole), F.col(asked))).select(*carry, n_words, spans)


def scan_documents(docs: DataFrame) -> DataFrame:
    """Digest of operator 13: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_spans."""
    found = scan(docs.select("doc_id", "text"), carry=["doc_id"])
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"].cast("long"))
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    says = F.transform("spans", lambda s: F.when(s["base"], F.lit(PHRASE_SCORE)).otherwise(s["share"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(says), F.lit(0.0)).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )
