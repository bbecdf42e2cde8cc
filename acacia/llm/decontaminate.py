"""Benchmark decontamination with an FM-index of each training shard.

A shard is one Arrow batch of documents. Its words are numbered by the benchmark's vocabulary; all
other words act as one separator, and runs between separators that are shorter than the shortest
benchmark phrase are left out, since no phrase can occur there. Over the rest a suffix array is
sorted, and a wavelet matrix over its Burrows-Wheeler transform answers ranks. All phrases search
backward together, occurrences are located by walking to sampled suffix positions, every word in them is
compared with the phrase's own, and their spans are merged into the words to remove.

The benchmark is cut into blocks of bounded bytes that go out one after the other; documents pass
through one stage for each block and carry the spans found so far along.

Defined cases: null texts and texts without words have no words, no hits and are clean; items that
are null or have no words, and items without an id, have no phrase; items of fewer words than a
window are one phrase; an item_id of any type counts as its text, and once if it occurs in several rows;
an empty benchmark leaves every document clean; a text is scanned whole, in a task's memory, however long
it is; repeated documents are judged one by one; an empty table gives no rows; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acacia.llm.words import IS_ALNUM, Words
from acacia.llm.work import free_name

WINDOW, SAMPLE = 13, 16
#: Bytes of benchmark text that go to the executors at once.
BLOCK_BYTES = 4 << 20


@dataclass
class Phrases:
    """The distinct windows of some items: vocabulary hashes (sorted) with their words, windows as rows of word numbers (from 1), and each window's items.

    ``seed`` is that of the word hash, and such that no two words of the vocabulary share one.
    """

    vocabulary: np.ndarray
    spelled: list[bytes]
    seed: int
    words: np.ndarray
    sizes: np.ndarray
    owners: list[list[str]]

    @classmethod
    def of(cls, items: list[tuple[str, str]], window: int = WINDOW) -> Phrases:
        found: dict[tuple[int, ...], list[str]] = {}
        kept = [(i, t) for i, t in items if i is not None and t]
        words = Words(pa.array([t for _, t in kept], pa.string()), IS_ALNUM, True)
        data = words.data.tobytes()
        own_words = [data[a:b] for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)]
        distinct, seed = len(set(own_words)), 0
        while len(np.unique(words.hashes(seed))) < distinct:
            seed += 1
        hashes = words.hashes(seed)
        vocabulary, first = np.unique(hashes, return_index=True)
        numbers = (np.searchsorted(vocabulary, hashes) + 1).tolist()
        for n, (item, _) in enumerate(kept):
            own = numbers[words.first[n] : words.first[n + 1]]
            for at in range(max(1, len(own) - window + 1)) if own else ():
                owners = found.setdefault(tuple(own[at : at + window]), [])
                if item not in owners:
                    owners.append(item)
        rows = np.zeros((len(found), window), np.int64)
        for n, phrase in enumerate(found):
            rows[n, : len(phrase)] = phrase
        return cls(vocabulary, [own_words[i] for i in first.tolist()], seed, rows, np.array([len(p) for p in found], np.int64), list(found.values()))

    def right(self, words: Words, start: np.ndarray, which: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether each occurrence has the words of its phrase and not others of the same hash. ``number``: the vocabulary number of each word, from 0."""
        edge = np.zeros(len(words) + 1, np.int64)
        np.add.at(edge, start, 1)
        np.add.at(edge, start + self.sizes[which], -1)
        hit = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        wrong = np.zeros(len(words) + 1, np.int64)
        spelled = self.spelled
        text, _ = words.joined(hit)
        for i, n, own in zip(hit.tolist(), number[hit].tolist(), text.split(b" "), strict=False):
            if own != spelled[n]:
                wrong[i + 1] = 1
        wrong = np.cumsum(wrong)
        return wrong[start + self.sizes[which]] == wrong[start]


class WaveletMatrix:
    """Ranks over a sequence of small integers, bit by bit from the highest."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels: list[tuple[int, int, np.ndarray]] = []
        for bit in reversed(range(max(1, int(top).bit_length()))):
            ones = (values >> bit) & 1
            before = np.zeros(len(values) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((bit, len(values) - int(before[-1]), before))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``upto`` values."""
        low, high = np.zeros(len(symbol), np.int64), np.asarray(upto, np.int64)
        for bit, zeros, before in self.levels:
            one = (symbol >> bit) & 1 == 1
            low_ones, high_ones = before[low], before[high]
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes in order; every 0 ends a run and counts as smaller than all words, and as different from every other 0."""
    n = len(text)
    ends = text == 0
    m = int(ends.sum())
    rank = np.where(ends, np.cumsum(ends) - 1, text + m - 1).astype(np.int64)
    span = 1
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        fresh = np.ones(n, bool)
        fresh[1:] = sorted_rank[1:] != sorted_rank[:-1]
        dense = np.empty(n, np.int64)
        dense[order] = np.cumsum(fresh) - 1
        if fresh.all():
            return order
        following = np.full(n, -1, np.int64)
        following[: n - span] = dense[span:]
        rank = dense * (n + 1) + following + 1
        order = np.argsort(rank, kind="stable")
        span *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, top: int):
        """``text``: runs of word numbers from 1 to ``top``, each ended by a 0."""
        order = suffix_array(text)
        self.transform = text[order - 1]
        self.ranks = WaveletMatrix(self.transform, top)
        counts = np.bincount(text, minlength=top + 1)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        sampled = (order % SAMPLE == 0) | (self.transform == 0)
        self.sampled = sampled
        self.which = np.cumsum(sampled) - 1
        self.positions = order[sampled]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all phrases at once: each one's range of suffixes."""
        low = np.zeros(len(sizes), np.int64)
        high = np.full(len(sizes), len(self.transform), np.int64)
        for step in range(int(sizes.max(initial=0))):
            on = np.flatnonzero((sizes > step) & (low < high))
            if not len(on):
                break
            symbol = phrases[on, sizes[on] - 1 - step]
            low[on] = self.before[symbol] + self.ranks.rank(symbol, low[on])
            high[on] = self.before[symbol] + self.ranks.rank(symbol, high[on])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: steps back to a sampled one, and as many forward."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        on = np.flatnonzero(~self.sampled[rows])
        while len(on):
            symbol = self.transform[rows[on]]
            rows[on] = self.before[symbol] + self.ranks.rank(symbol, rows[on])
            steps[on] += 1
            on = on[~self.sampled[rows[on]]]
        return self.positions[self.which[rows]] + steps


def occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """First word (counted over all texts) and phrase number of each occurrence in a shard."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(words) or not len(phrases.sizes):
        return nothing
    hashes = words.hashes(phrases.seed)
    at = np.minimum(np.searchsorted(phrases.vocabulary, hashes), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == hashes
    begins = known.copy()
    begins[1:] &= ~known[:-1]
    text_starts = words.first[:-1][words.first[:-1] < len(words)]
    begins[text_starts] = known[text_starts]
    where = np.flatnonzero(known)
    if not len(where):
        return nothing
    run = np.cumsum(begins[where]) - 1
    sizes = np.bincount(run)
    long = sizes >= phrases.sizes.min()
    where, run = where[long[run]], run[long[run]]
    if not len(where):
        return nothing
    place = np.arange(len(where)) + np.cumsum(np.concatenate([[0], run[1:] != run[:-1]]))
    text = np.zeros(int(place[-1]) + 2, np.int64)
    text[place] = at[where] + 1
    origin = np.zeros(len(text), np.int64)
    origin[place] = where
    index = FMIndex(text, len(phrases.vocabulary))
    low, high = index.search(phrases.words, phrases.sizes)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    start = origin[index.locate(rows)]
    right = phrases.right(words, start, which, at)
    return start[right], which[right]


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping or touching spans as one; sorted by start."""
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    fresh = np.ones(len(start), bool)
    fresh[1:] = start[1:] > reach[:-1]
    last = np.append(np.flatnonzero(fresh)[1:] - 1, len(start) - 1)
    return start[fresh], reach[last]


def _scan(batch: pa.RecordBatch, text_at: int, phrases: Phrases, spans: list, items: list) -> tuple[np.ndarray, list, list]:
    """Words of each text, and the spans (flat, from word 0) and items found so far and now."""
    words = Words(batch.column(text_at), IS_ALNUM, True)
    counts = np.diff(words.first)
    start, which = occurrences(words, phrases)
    if len(start):
        text = np.searchsorted(words.first, start, "right") - 1
        order = np.argsort(text, kind="stable")
        found, first = np.unique(text[order], return_index=True)
        for doc, own in zip(found.tolist(), np.split(order, first[1:]), strict=False):
            begin = start[own] - words.first[doc]
            end = begin + phrases.sizes[which[own]]
            old = np.asarray(spans[doc], np.int64).reshape(-1, 2)
            begin, end = _merged(np.concatenate([old[:, 0], begin]), np.concatenate([old[:, 1], end]))
            spans[doc] = np.stack([begin, end], axis=1).ravel().tolist()
            items[doc] = sorted({*items[doc], *(i for w in np.unique(which[own]).tolist() for i in phrases.owners[w])})
    return counts, spans, items


def scanned(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, dict[str, str]]:
    """The columns ``keep`` (all, if None) and three more: words, merged spans and item ids; with the names that those got."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    names = {k: free_name(k, docs.columns) for k in ("n_words", "spans", "items")}
    added = [T.StructField(names[k], t) for k, t in (("n_words", T.LongType()), ("spans", T.ArrayType(T.LongType())), ("items", T.ArrayType(T.StringType())))]
    out = docs
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about block_bytes
        phrases = spark.sparkContext.broadcast(Phrases.of([(r["item_id"], r["text"]) for r in rows], window))
        kept = docs.columns if keep is None or block < blocks - 1 else keep
        schema = T.StructType([docs.schema[c] for c in kept] + added)

        def run(batches: Iterator[pa.RecordBatch], first=block == 0, phrases=phrases, kept=tuple(kept)) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                spans, found = ([[] for _ in range(n)] for _ in range(2)) if first else (batch.column(batch.num_columns - i).to_pylist() for i in (2, 1))
                counts, spans, found = _scan(batch, batch.schema.get_field_index("text"), phrases.value, spans, found)
                own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                more = [pa.array(counts), pa.array(spans, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(own + more, [*kept, *names.values()])

        out = out.mapInArrow(run, schema)
    return out, names


def contaminated(n_hit, n_words):
    """The rule: at least one twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def _hits(spans):
    """Ends minus starts of the flat spans."""
    signed = F.transform(spans, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda total, x: total + x)


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row for each document: words, words hit, items found, their digest and the verdict."""
    found, names = scanned(docs.select("doc_id", "text"), benchmark, ["doc_id"], window)
    items = F.array_sort(names["items"])
    n_hit = _hits(F.col(names["spans"]))
    return found.select(
        "doc_id",
        F.col(names["n_words"]).alias("n_words"),
        n_hit.alias("n_hit"),
        F.size(names["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        contaminated(n_hit, F.col(names["n_words"])).alias("contaminated"),
        F.col(names["spans"]).alias("removal_spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that the rule does not reject, with all their columns."""
    found, names = scanned(docs, benchmark, None, window)
    return found.where(~contaminated(_hits(F.col(names["spans"])), F.col(names["n_words"]))).select(*[F.col(f"`{c}`") for c in docs.columns])
