"""License scan by diagonal voting.

Every document's rolling word 2-gram hashes meet the positions of those grams in the license
templates in a Spark join. A meeting votes for the diagonal ``document position - template
position``; votes are added up by document, template and diagonal. Documents whose votes for a template are
too few for it (all grams on one diagonal for a base phrase, ``COVERAGE`` of them on all for a notice) drop
out; for the rest, neighbouring diagonals (words inserted or left out) are merged, and the merged span is
verified against the words themselves, which texts and votes are dealt by row for: votes grow with the corpus,
and are never sent to all tasks.

Short templates are the contract's base phrases and count only where all their words stand
consecutively. Longer notices are the method's own and count from ``COVERAGE`` of their grams on.

Defined cases: null texts are empty and have no words; texts without a phrase give zero places, null
positions, empty labels and score 0; overlapping places all count; a text's votes and words fit a task's
memory, however long it is; repeated rows are reported one by one; an empty table gives no rows; other
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acacia.llm.words import ALNUM_TABLE, IS_ALNUM, Words, lists, paired
from acacia.llm.work import written

#: The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
#: Notices of the method's own.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache"),
    ("this work is licensed under a creative commons attribution", "cc"),
    ("all rights reserved", "proprietary"),
)
COVERAGE, DRIFT = 0.8, 3
#: Template grams up to which they are sent to all tasks; beyond it the join is left to Spark.
BROADCAST_GRAMS = 100_000

_RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word with the next one of its text, and how many each text has."""
    hashes = words.hashes()
    counts = np.maximum(np.diff(words.first) - 1, 0)
    inside = np.ones(len(hashes), bool)
    ends = words.first[1:] - 1
    inside[ends[np.diff(words.first) > 0]] = False
    at = np.flatnonzero(inside)
    return paired(hashes[at], hashes[np.minimum(at + 1, len(hashes) - 1)]) if len(at) else np.zeros(0, np.uint64), counts


def template_rows(templates: list[str]) -> list[tuple[int, int, int]]:
    """(gram, template, position) of each template gram."""
    own, counts = grams(Words(pa.array(templates), IS_ALNUM, True))
    number = np.repeat(np.arange(len(templates)), counts)
    position = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    return list(zip(own.view(np.int64).tolist(), number.tolist(), position.tolist(), strict=True))


def _verified(words: list[bytes], votes: list[dict], templates: list[list[bytes]], base: int) -> tuple[list[int], set[int], float]:
    """Starts of base places, the templates found, and the best coverage."""
    starts: list[int] = []
    found: set[int] = set()
    best = 0.0
    by_template: dict[int, list[dict]] = {}
    for v in votes:
        by_template.setdefault(v["template"], []).append(v)
    for t, own in by_template.items():
        phrase = templates[t]
        if t < base:
            places = {v["diagonal"] for v in own if v["diagonal"] >= 0 and words[v["diagonal"] : v["diagonal"] + len(phrase)] == phrase}
            starts += places
            if places:
                found.add(t)
                best = 1.0
            continue
        own.sort(key=lambda v: (v["low"], v["diagonal"]))
        span: list[dict] = []
        for v in [*own, None]:
            if v is not None and (not span or (abs(v["diagonal"] - span[-1]["diagonal"]) <= DRIFT and v["low"] - span[-1]["high"] <= len(phrase))):
                span.append(v)
                continue
            low, high = min(x["low"] for x in span), max(x["high"] for x in span) + 2
            there = set(zip(words[low : high - 1], words[low + 1 : high], strict=False))
            wanted = list(zip(phrase, phrase[1:], strict=False))
            share = sum(g in there for g in wanted) / len(wanted)
            if share >= COVERAGE:
                found.add(t)
                best = max(best, share)
            span = [v] if v is not None else []
    return starts, found, best


def scan(docs: DataFrame, base=BASE, notices=NOTICES) -> DataFrame:
    spark = docs.sparkSession
    phrases = [p for p, _ in (*base, *notices)]
    labels = [x for _, x in (*base, *notices)]
    templates = [p.encode().translate(ALNUM_TABLE).split() for p in phrases]
    rows = template_rows(phrases)
    table = spark.createDataFrame(rows, "gram long, template int, position int")
    if len(rows) <= BROADCAST_GRAMS:
        table = F.broadcast(table)
    keyed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("doc_id").alias("key1"),
        F.xxhash64("text").alias("key2"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, counts = grams(Words(batch.column(2), IS_ALNUM, True))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists(own.view(np.int64), counts, pa.int64())], ["key1", "key2", "grams"])

    rolling = keyed.select("key1", "key2", "text").mapInArrow(hashed, "key1 long, key2 long, grams array<long>")
    met = rolling.select("key1", "key2", F.posexplode("grams").alias("at", "gram")).join(table, "gram")
    votes = met.groupBy("key1", "key2", "template", (F.col("at") - F.col("position")).alias("diagonal")).agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count(F.lit(1)).alias("n"))
    sizes = [len(t) - 1 for t in templates]
    need = F.element_at(F.array(*[F.lit(n if t < len(base) else math.ceil(COVERAGE * n)) for t, n in enumerate(sizes)]), F.col("template") + 1)
    # A base phrase has all its grams on one diagonal; a notice has its share of them on all of the document's.
    votes = votes.where((F.col("template") >= len(base)) | (F.col("n") >= need))
    enough = votes.groupBy("key1", "key2", "template").agg(F.sum("n").alias("n"), F.collect_list(F.struct("template", "diagonal", "low", "high")).alias("votes")).where(F.col("n") >= need)
    hits = written(enough.groupBy("key1", "key2").agg(F.flatten(F.collect_list("votes")).alias("votes")), "votes")
    joined = keyed.join(hits.hint("merge"), ["key1", "key2"], "left").select("doc_id", "text", "votes")
    n_base = len(base)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {name.split()[0]: [] for name in _RESULT.split(", ")}
            counts = np.diff(Words(batch.column(1), IS_ALNUM, True).first)
            texts = batch.column(1)
            for i, votes in enumerate(batch.column(2).to_pylist()):
                starts, found, best = [], set(), 0.0
                if votes:
                    starts, found, best = _verified(texts[i].as_py().translate(ALNUM_TABLE).split(), votes, templates, n_base)
                out["n_base"].append(len(starts))
                out["first_word"].append(min(starts, default=None))
                out["last_word"].append(max(starts, default=None))
                out["base_labels"].append(",".join(sorted({labels[t] for t in found if t < n_base})))
                out["labels"].append(",".join(sorted({labels[t] for t in found})))
                out["score"].append(best)
            out["n_words"] = counts
            out["doc_id"] = batch.column(0)
            kinds = {"score": pa.float64(), "base_labels": pa.string(), "labels": pa.string()}
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) if k != "doc_id" else v for k, v in out.items()], list(out))

    return joined.mapInArrow(verify, _RESULT)
