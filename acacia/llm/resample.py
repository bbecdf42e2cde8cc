"""Importance resampling of documents toward a target text collection, over hashed word n-grams.

Features are all runs of one to three consecutive words, joined by a space; the bucket of a feature is
its CRC-32 modulo ``BUCKETS``. A document's weight is the sum of its features' log ratios of target and corpus
bucket shares; Gumbel noise from a digest of its id is added, and the documents with the highest
scores are drawn, which is sampling without replacement by weight.

The vocabulary has a head and a tail. Words frequent in some part of the corpus are counted over all
documents; the most frequent (``HEAD_WORDS``) go out as a broadcast with their CRC states, as do the most
frequent pairs of them (``HEAD_PAIRS``) with bucket and state. A word of the head is recognised by its
bytes, takes its state and never has its letters read; every other word gets its CRC from its
letters, every other pair and every triple by carrying the state of its first part on over the next word.
Both give the same number, so that the size of the head decides speed alone and all bucket totals are exact.

Ranks come from one range-partitioned sort of ids and scores (no text): positions in the parts and the
parts' sizes give them, so no task sees all rows.

Defined cases: a null text has no words; a null doc_id counts as an empty text in its digest and comes first
among ties; repeated rows are documents of their own; documents without words weigh 0 and are never drawn
where ``least_words`` is positive; words of any length; an empty corpus or target counts as buckets of 0; columns
that aren't kept are ignored, and kept ones give way to the operator's own of the same name.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acacia.llm.words import IS_ALNUM, Words, mixed, pieces
from acacia.llm.work import free_name, partitions, written

#: Buckets of features, and what takes part in the draw.
BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 5, 42
#: Bounds of the broadcast head: words, their bytes, and pairs.
HEAD_WORDS, HEAD_BYTES, HEAD_PAIRS = 1 << 15, 32, 1 << 16
#: A word or pair is frequent in a part of a task's text if it makes up one in so many of its words.
_FREQUENT = 1 << 16
#: Slots by which a word or pair finds its place in the head.
_WORD_BITS, _PAIR_BITS = 18, 19

_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LONG = 64


def _crc_table() -> np.ndarray:
    """The remainders of all bytes, for the reflected polynomial 0xEDB88320."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1))
    return c


_TABLE = _crc_table()


def _zeros() -> tuple[np.ndarray, np.ndarray]:
    """What any byte of a state becomes after 0 to 63 further zero bytes, and after 64, 128, 256 and so on."""
    state = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    few = [state]
    for _ in range(64):
        state = _TABLE[state & 0xFF] ^ (state >> np.uint32(8))
        few.append(state)
    many = [few.pop()]
    for _ in range(25):
        many.append(_over(many[-1], many[-1]))
    return np.stack(few), np.stack(many)


def _over(op: np.ndarray, state: np.ndarray) -> np.ndarray:
    """A step given by the four bytes' tables, applied to states."""
    b = np.uint32(8)
    return op[0][state & 0xFF] ^ op[1][(state >> b) & 0xFF] ^ op[2][(state >> (b + b)) & 0xFF] ^ op[3][state >> np.uint32(24)]


_FEW, _MANY = _zeros()
_FEW_FLAT = _FEW.reshape(-1)


def advanced(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part that a text's CRC-32 has in that of the text with ``n`` more bytes after it; the other part is the CRC-32 of those bytes."""
    out = crc.astype(np.uint32)
    for i in np.flatnonzero(n >= _LONG).tolist():
        for j in range(int(n[i]).bit_length() - 6):
            if int(n[i]) >> (6 + j) & 1:
                out[i : i + 1] = _over(_MANY[j], out[i : i + 1])
    at = (n & (_LONG - 1)).astype(np.int64) << 10
    f = _FEW_FLAT
    return f[at + (out & 0xFF)] ^ f[at + 256 + ((out >> np.uint32(8)) & 0xFF)] ^ f[at + 512 + ((out >> np.uint32(16)) & 0xFF)] ^ f[at + 768 + (out >> np.uint32(24))]


def _direct(words: Words, which: np.ndarray) -> np.ndarray:
    """CRC-32 of some words, from their letters."""
    size = (words.end - words.start)[which]
    start = words.start[which]
    out = np.full(len(which), 0xFFFFFFFF, np.uint32)
    on, at = np.flatnonzero(size <= _LONG), 0
    while len(on):
        out[on] = _TABLE[(out[on] ^ words.data[start[on] + at]) & 0xFF] ^ (out[on] >> np.uint32(8))
        at += 1
        on = on[size[on] > at]
    out = ~out
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = zlib.crc32(words.data[start[i] : start[i] + size[i]].tobytes())
    return out


def _chunks(words: Words, which: np.ndarray) -> np.ndarray:
    """The bytes of words of up to HEAD_BYTES bytes as rows of 64-bit numbers, zeros after their end."""
    size = (words.end - words.start)[which]
    padded = np.concatenate([words.data, np.zeros(HEAD_BYTES + 8, np.uint8)])
    eights = np.ndarray(len(words.data) + HEAD_BYTES + 1, "<u8", padded, strides=(1,))
    return np.stack([eights[words.start[which] + k] & _MASKS[np.clip(size - k, 0, 8)] for k in range(0, HEAD_BYTES, 8)], axis=1)


@dataclass
class Head:
    """Frequent words with the CRC-32 of the word and of a space and the word, and frequent pairs with CRC-32 and bucket. A slot that two share holds the more frequent."""

    size: np.ndarray
    chunks: np.ndarray
    alone: np.ndarray
    spaced: np.ndarray
    word_slots: np.ndarray
    pairs: np.ndarray
    pair_crc: np.ndarray
    pair_bucket: np.ndarray
    pair_slots: np.ndarray

    @classmethod
    def of(cls, words: list[bytes], pairs: list[tuple[bytes, bytes]], buckets: int = BUCKETS) -> Head:
        """Words and pairs by falling frequency; pairs of other words are left out."""
        number = {w: i for i, w in enumerate(words)}
        spans = Words(pa.array(words, pa.binary()), np.ones(256, bool), lower=False)
        everyone = np.arange(len(words))
        known = [(number[a], number[b], zlib.crc32(a + b" " + b)) for a, b in pairs if a in number and b in number]
        keys = np.array([(a << 32) | b for a, b, _ in known], np.uint64)
        crc = np.array([c for _, _, c in known], np.uint32)
        return cls(
            size=np.array([len(w) for w in words], np.int64),
            chunks=_chunks(spans, everyone) if words else np.zeros((0, HEAD_BYTES // 8), np.uint64),
            alone=np.array([zlib.crc32(w) for w in words], np.uint32),
            spaced=np.array([zlib.crc32(b" " + w) for w in words], np.uint32),
            word_slots=_slots(spans.hashes() if words else np.zeros(0, np.uint64), _WORD_BITS),
            pairs=keys, pair_crc=crc, pair_bucket=(crc % np.uint32(buckets)).astype(np.int32), pair_slots=_slots(mixed(keys), _PAIR_BITS),
        )

    def numbers(self, words: Words, hashes: np.ndarray) -> np.ndarray:
        """Each word's number in the head, or -1. Words are compared byte by byte."""
        if not len(self.size):
            return np.full(len(words), -1, np.int64)
        out = self.word_slots[(hashes >> np.uint64(64 - _WORD_BITS)).astype(np.int64)].astype(np.int64)
        on = np.flatnonzero(out >= 0)
        alike = self.size[out[on]] == (words.end - words.start)[on]
        out[on[~alike]] = -1
        on = on[alike]
        out[on[(_chunks(words, on) != self.chunks[out[on]]).any(axis=1)]] = -1
        return out


def _slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    out = np.full(1 << bits, -1, np.int32)
    back = np.arange(len(hashes) - 1, -1, -1)  # the most frequent is written last
    out[(hashes[back] >> np.uint64(64 - bits)).astype(np.int64)] = back
    return out


def buckets_of(words: Words, head: Head, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of all features of some texts, and the index of each feature's text."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text, size = words.text_of(), words.end - words.start
    number = head.numbers(words, words.hashes())
    tail = np.flatnonzero(number < 0)
    alone, spaced = np.empty(len(words), np.uint32), np.empty(len(words), np.uint32)
    alone[number >= 0], spaced[number >= 0] = head.alone[number[number >= 0]], head.spaced[number[number >= 0]]
    alone[tail] = _direct(words, tail)
    spaced[tail] = advanced(np.full(len(tail), zlib.crc32(b" "), np.uint32), size[tail]) ^ alone[tail]
    m = np.uint32(buckets)
    of, owner = [(alone % m).astype(np.int64)], [text]

    first = np.flatnonzero(text[1:] == text[:-1])  # where a pair begins
    crc = np.zeros(len(words), np.uint32)
    bucket = np.zeros(len(words), np.int64)
    left = first
    if len(head.pairs):
        both = first[(number[first] >= 0) & (number[first + 1] >= 0)]
        keys = (number[both].astype(np.uint64) << np.uint64(32)) | number[both + 1].astype(np.uint64)
        at = head.pair_slots[(mixed(keys) >> np.uint64(64 - _PAIR_BITS)).astype(np.int64)]
        hit = (at >= 0) & (head.pairs[at] == keys)
        crc[both[hit]], bucket[both[hit]] = head.pair_crc[at[hit]], head.pair_bucket[at[hit]]
        known = np.zeros(len(words), bool)
        known[both[hit]] = True
        left = first[~known[first]]
    crc[left] = advanced(alone[left], size[left + 1] + 1) ^ spaced[left + 1]
    bucket[left] = crc[left] % m
    of.append(bucket[first])
    owner.append(text[first])

    third = first[:-1][first[1:] == first[:-1] + 1] if len(first) else first
    of.append(((advanced(crc[third], size[third + 2] + 1) ^ spaced[third + 2]) % m).astype(np.int64))
    owner.append(text[third])
    return np.concatenate(of), np.concatenate(owner)


def _frequent(docs: DataFrame) -> tuple[list[bytes], list[tuple[bytes, bytes]]]:
    """The head's words and pairs by falling count over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 0):
                words = Words(part.column(0), IS_ALNUM, lower=True)
                _, first, place, n = np.unique(words.hashes(), return_index=True, return_inverse=True, return_counts=True)
                least = max(2, len(words) // _FREQUENT)
                often = (n >= least) & ((words.end - words.start)[first] <= HEAD_BYTES)
                texts = [words.data[words.start[i] : words.end[i]].tobytes() for i in first[often].tolist()]
                number = np.where(often, np.cumsum(often) - 1, -1)[place]
                text = words.text_of()
                a = np.flatnonzero((text[1:] == text[:-1]) & (number[1:] >= 0) & (number[:-1] >= 0))
                keys, m = np.unique(number[a] * max(1, len(texts)) + number[a + 1], return_counts=True)
                keys, m = keys[m >= least], m[m >= least]
                lefts, rights = keys // max(1, len(texts)), keys % max(1, len(texts))
                a = texts + [texts[i] for i in lefts.tolist()]
                b = [None] * len(texts) + [texts[i] for i in rights.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(np.concatenate([n[often], m]).astype(np.int64))], ["a", "b", "n"])

    counts = written(docs.mapInArrow(run, "a binary, b binary, n long").groupBy("a", "b").agg(F.sum("n").alias("n")), "frequent")
    words = counts.where("b IS NULL").orderBy(F.desc("n"), "a").limit(HEAD_WORDS).select("a").toArrow()["a"].to_pylist()
    pairs = counts.where("b IS NOT NULL").orderBy(F.desc("n"), "a", "b").limit(HEAD_PAIRS).select("a", "b").toArrow()
    return words, list(zip(pairs["a"].to_pylist(), pairs["b"].to_pylist(), strict=True))


def head_of(docs: DataFrame, text: str = "text") -> Head:
    """The head of a corpus's vocabulary."""
    return Head.of(*_frequent(docs.select(F.col(text).alias("text"))))


def totals(docs: DataFrame, head: Head, text: str = "text") -> np.ndarray:
    """How many features of all texts fall in each bucket."""
    shared = docs.sparkSession.sparkContext.broadcast(head)  # bounded by HEAD_WORDS and HEAD_PAIRS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in pieces(batch, 0):
                counts += np.bincount(buckets_of(Words(part.column(0), IS_ALNUM, lower=True), shared.value)[0], minlength=BUCKETS)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held])], ["bucket", "n"])

    sums = docs.select(F.col(text).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[np.asarray(sums["bucket"])] = np.asarray(sums["n"])
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and corpus, rounded down."""
    whole, wanted = float(corpus.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(1000 * math.log((t + 1.0) * whole / ((s + 1.0) * wanted))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


#: Columns that replace kept ones of their names, whatever the case.
_MADE = ("n_words", "n_features", "weight", "score", "rank")


def weighed(docs: DataFrame, head: Head, gain: np.ndarray, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns with n_words, n_features and weight of each document."""
    shared = docs.sparkSession.sparkContext.broadcast((head, gain))
    keep = tuple(c for c in keep if c.lower() not in _MADE)
    own = free_name("text", list(keep))
    narrow = docs.select(*keep, F.col(text).alias(own))
    schema = T.StructType([*narrow.schema.fields[:-1], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, len(keep)):
                words = Words(part.column(len(keep)), IS_ALNUM, lower=True)
                bucket, owner = buckets_of(words, shared.value[0])
                n = len(words.first) - 1
                sums = np.zeros(n + 1, np.int64)
                np.add.at(sums, owner, shared.value[1][bucket])
                made = (np.diff(words.first), np.bincount(owner, minlength=n)[:n], sums[:n])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(x.astype(np.int64)) for x in made)], [*part.schema.names[:-1], "n_words", "n_features", "weight"])

    return narrow.mapInArrow(run, schema)


def scored(docs: DataFrame, target: DataFrame, keep: tuple[str, ...] = ("doc_id",), seed: int = SEED) -> DataFrame:
    """The kept columns (doc_id among them) with n_words, n_features, weight and score."""
    head = head_of(docs)
    gain = gains(totals(docs, head), totals(target, head))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    return weighed(docs, head, gain, keep).withColumn("score", F.col("weight") + noise)


def drawn(docs: DataFrame, target: DataFrame, keep: tuple[str, ...] = ("doc_id",), percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """All documents' kept columns with n_words, n_features, weight, score and, for the drawn ones, their rank from 1."""
    spark = docs.sparkSession
    table = written(scored(docs, target, keep, seed), "scores")
    eligible = F.coalesce(F.col("n_words") >= least_words, F.lit(False))
    part, place = free_name("part", table.columns), free_name("place", [*table.columns, "part"])
    keys = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("weight")]
    spread = free_name("spread", table.columns)
    # Rows that agree in all keys are dealt out by a number of their own, so that no part holds all copies of one.
    sorted_ = (
        table.where(eligible).withColumn(spread, F.monotonically_increasing_id())
        .repartitionByRange(partitions(spark), *keys, F.col(spread)).sortWithinPartitions(*keys, F.col(spread)).drop(spread)
        .withColumn(place, F.monotonically_increasing_id())
        .withColumn(part, F.shiftright(place, 33)).withColumn(place, F.col(place).bitwiseAND((1 << 33) - 1))
    )
    sorted_ = written(sorted_, "ranked")
    sizes = sorted(sorted_.groupBy(part).count().collect())  # a row for each part
    most, before, starts = percent * sum(n for _, n in sizes) // 100, 0, []
    for p, n in sizes:
        starts.append((p, before))
        before += n
    start = F.broadcast(spark.createDataFrame(starts, f"{part} long, {place}_start long"))  # a row for each part
    rank = F.col(place) + F.col(f"{place}_start") + 1
    ranked = sorted_.join(start, part, "left").withColumn("rank", F.when(rank <= most, rank)).drop(part, place, f"{place}_start")
    return ranked.unionByName(table.where(~eligible).withColumn("rank", F.lit(None).cast("long")))
