"""Substring dedup by recompression.

Every text's words are named by hash, and rounds of recompression rename them: maximal runs of one
symbol become one symbol, then each pair whose left symbol drew "left" and whose right symbol drew
"right" becomes one symbol. Names are hashes of what they stand for, so equal substrings get equal
interior symbols in all documents without a dictionary. Only symbols near an edge can differ, and how
far the edges reach follows from the substring alone (``Parse.inner_left`` and ``inner_right``).

A window can occur twice only if all symbols in its interior do. One exchange finds the symbols that
occur more than once (a hash that two of them share by chance makes more windows possible, and removes
nothing); the windows that stay possible are verified in a second exchange by 128 bits of a cryptographic
digest (BLAKE2b) of their words, written out with one space between them. In both, each batch sends every
distinct name once, packed by bucket, so a frequent name weighs no more than a rare one. The number of
buckets follows from the bytes of text, so that the memory of one doesn't grow with the corpus.

Defined cases: null texts have no words; texts shorter than a window are kept whole; a text is parsed
whole, in a task's memory, however long it is (some fifteen times its bytes); repeated rows repeat each
other and lose every word covered by a window; a null doc_id is kept as such; an empty table gives no
rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acacia.llm.words import IS_SPACED, Words, mixed, paired, pieces
from acacia.llm.work import partitions, written

WINDOW, ROUNDS = 35, 4
#: Bytes of text whose names make a bucket.
BUCKET_BYTES = 64 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Parse:
    """Words of several texts after some rounds, with each window's interior."""

    def __init__(self, words: Words, rounds: int = ROUNDS, edges: bool = False):
        n = len(words)
        self.words = words
        names = words.hashes()
        text = words.text_of()
        start = np.arange(n + 1)  # word at which each symbol starts, and the end
        # From a word border to the border after which (before which) symbols depend on the window alone.
        inner_left = np.arange(n + 1)
        inner_right = np.arange(n + 1)
        for step in range(rounds):
            # Runs.
            m = len(names)
            same = np.zeros(m, bool)
            if m:
                same[1:] = (names[1:] == names[:-1]) & (text[1:] == text[:-1])
            head = np.flatnonzero(~same)
            size = np.diff(np.append(head, m))
            if edges:
                run = np.cumsum(~same) - 1
                borders = start[np.append(head, m)]
                inner_left = self._moved(inner_left, start, np.append(borders[run + 1], n) if m else borders)
                inner_right = self._moved(inner_right, start, np.concatenate([[0], borders[run]]) if m else borders)
            if len(head) < m:
                names = np.where(size > 1, mixed(names[head] ^ (size.astype(np.uint64) * _ODD)), names[head])
                text = text[head]
                start = np.append(start[head], n)
            # Pairs.
            m = len(names)
            right = (names >> np.uint64(step)) & np.uint64(1) == 1
            joined = np.zeros(m, bool)  # to the symbol before
            if m:
                joined[1:] = right[1:] & ~right[:-1] & (text[1:] == text[:-1])
            if edges:
                inner_left = self._moved(inner_left, start, np.append(np.where(right, start[1:], start[:-1]), n))
                inner_right = self._moved(inner_right, start, np.concatenate([[0], np.where(right, start[1:], start[:-1])]))
            head = np.flatnonzero(~joined)
            if len(head) < m:
                second = np.append(joined[1:], False)[head]
                following = names[np.minimum(head + 1, m - 1)]
                names = np.where(second, paired(names[head], following), names[head])
                text = text[head]
                start = np.append(start[head], n)
        self.names, self.start, self.text = names, start, text
        self.inner_left, self.inner_right = inner_left, inner_right

    @staticmethod
    def _moved(border: np.ndarray, start: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Borders that are symbol borders move on; the others lie in a symbol that has swallowed them and stay."""
        n = len(border) - 1
        table = np.arange(n + 1)
        table[start] = to
        return table[border]

    def possible(self, shared: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """First words of the windows whose interior symbols are all shared."""
        n = len(self.words)
        first = self.words.first
        last = np.repeat(first[1:], np.diff(first)) - window  # last start in each word's text
        begin = np.flatnonzero(np.arange(n) <= last)
        rare = np.concatenate([[0], np.cumsum(~shared)])
        at = np.searchsorted(self.start, np.arange(n + 1))  # first symbol that starts at a word border or after it
        low, high = self.inner_left[begin], self.inner_right[begin + window]
        low, high = at[low], np.searchsorted(self.start, high, "right") - 1
        return begin[(high <= low) | (rare[np.maximum(high, low)] == rare[low])]


def window_names(words: Words, begin: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of a digest of each window's words, as two numbers."""
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + window, -1)
    inside = np.cumsum(edge)[:-1] > 0
    text, start = words.joined(np.flatnonzero(inside))
    place = np.cumsum(inside) - 1
    last = place[begin + window - 1]
    ends = np.append(start, len(text))[last + 1] - 1
    blake2b = hashlib.blake2b
    digests = [blake2b(text[a:b], digest_size=16).digest() for a, b in zip(start[place[begin]].tolist(), ends.tolist(), strict=True)]
    both = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


_PACKED = "bucket int, batch string, once binary, checks binary, refs binary, often binary, often_checks binary, head binary"
_FIELDS = [c.split()[0] for c in _PACKED.split(", ")]


def _packed(names: np.ndarray, checks: np.ndarray | None, buckets: int, head: bytes) -> pa.RecordBatch:
    """One row for each bucket with the batch's distinct names (and further bits of each), and one with what the batch must remember.

    ``refs`` are the places of names that occur once in the batch; places of the others are shared already and stay in ``head``.
    """
    batch = hashlib.sha256(head + names.tobytes()).hexdigest()[:32]  # a task that runs again finds the same name
    order = np.argsort(names, kind="stable") if checks is None else np.lexsort((checks, names))
    s = names[order]
    fresh = np.ones(len(s), bool)
    fresh[1:] = s[1:] != s[:-1]
    if checks is not None:
        fresh[1:] |= np.diff(checks[order]) != 0
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(s)))
    single = count == 1
    known = np.sort(order[np.repeat(~single, count)]).astype(np.uint32)
    bucket = ((s[first] >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)
    cols: dict[str, list] = {f: [] for f in _FIELDS}

    def row(**values) -> None:
        for f in _FIELDS:
            cols[f].append(values.get(f))

    def bits(which: np.ndarray) -> bytes | None:
        return None if checks is None else checks[order[which]].tobytes()

    by = np.argsort(bucket, kind="stable")
    found, at = np.unique(bucket[by], return_index=True)
    for b, own in zip(found.tolist(), np.split(by, at[1:]), strict=False):
        one, more = first[own[single[own]]], first[own[~single[own]]]
        row(bucket=b, batch=batch, once=s[one].tobytes(), checks=bits(one), refs=order[one].astype(np.uint32).tobytes(), often=s[more].tobytes(), often_checks=bits(more))
    row(bucket=int(batch[:8], 16) % buckets, batch=batch, refs=known.tobytes(), head=head)
    kinds = {"bucket": pa.int32(), "batch": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(f, pa.binary())) for f, v in cols.items()], _FIELDS)


def _met(table: pa.Table) -> pa.Table:
    """One bucket: the places whose name occurs in another batch too; heads pass through."""
    rows = table.to_pylist()
    out: dict[str, list] = {"batch": [], "refs": [], "head": []}

    def row(batch: str, refs: bytes, head: bytes | None) -> None:
        for column, value in zip(out.values(), (batch, refs, head), strict=True):
            column.append(value)

    names, checks, singles, at = [], [], [], 0
    for r in rows:
        if r["head"] is not None:
            row(r["batch"], r["refs"], r["head"])
            continue
        singles.append((r["batch"], r["refs"], at, at + len(r["once"]) // 8))
        for key, more in (("once", "checks"), ("often", "often_checks")):
            names.append(np.frombuffer(r[key], np.uint64))
            if r[more] is not None:
                checks.append(np.frombuffer(r[more], np.uint64))
            at += len(names[-1])
    if names:
        n = np.concatenate(names)
        c = np.concatenate(checks) if checks else None
        order = np.argsort(n, kind="stable") if c is None else np.lexsort((c, n))
        equal = n[order[1:]] == n[order[:-1]]
        if c is not None:
            equal &= c[order[1:]] == c[order[:-1]]
        shared = np.zeros(len(n), bool)
        shared[order[1:]] |= equal
        shared[order[:-1]] |= equal
        for batch, refs, low, high in singles:
            if shared[low:high].any():
                row(batch, np.frombuffer(refs, np.uint32)[shared[low:high]].tobytes(), None)
    return pa.table({"batch": pa.array(out["batch"], pa.string()), "refs": pa.array(out["refs"], pa.binary()), "head": pa.array(out["head"], pa.binary())})


def _head(key1: np.ndarray, key2: np.ndarray, *more: np.ndarray) -> bytes:
    """Several integer arrays, with their lengths in front."""
    arrays = [np.asarray(a, np.int64) for a in (key1, key2, *more)]
    return np.concatenate([np.array([len(arrays), *map(len, arrays)], np.int64), *arrays]).tobytes()


def _unpacked(head: bytes) -> list[np.ndarray]:
    flat = np.frombuffer(head, np.int64)
    sizes = flat[1 : 1 + flat[0]]
    return np.split(flat[1 + flat[0] :], np.cumsum(sizes)[:-1])


def _together(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray]:
    """One batch again: its head and all its shared places, in order."""
    head = next(h for h in table["head"].to_pylist() if h is not None)
    refs = np.frombuffer(b"".join(table["refs"].to_pylist()), np.uint32).astype(np.int64)
    return _unpacked(head), np.unique(refs)


def _exchanged(packed: DataFrame, buckets: int) -> DataFrame:
    """Every batch with its shared places; there are as many tasks as buckets, so that one holds few of them."""
    met = packed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_met, "batch string, refs binary, head binary")
    return met.repartition(buckets, "batch").groupBy("batch")


_BITS = "key1 long, key2 long, found binary"


def _per_text(key1: np.ndarray, key2: np.ndarray, found: list[bytes]) -> pa.Table:
    keep = [i for i, f in enumerate(found) if f]
    return pa.table({"key1": pa.array(key1[keep], pa.int64()), "key2": pa.array(key2[keep], pa.int64()), "found": pa.array([found[i] for i in keep], pa.binary())})


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows by 128 bits of hash of their id and text: equal rows share them, and get equal results; copies with other ids don't meet in one task."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(F.xxhash64("doc_id", text).alias("key1"), F.xxhash64(text).alias("key2"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def shared_symbols(docs: DataFrame, buckets: int, rounds: int) -> DataFrame:
    """For each text with any, one bit for each of its symbols: whether it occurs elsewhere."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, 2)):
            parse = Parse(Words(batch.column(2), IS_SPACED, False), rounds)
            sizes = np.bincount(parse.text, minlength=batch.num_rows)
            yield _packed(parse.names, None, buckets, _head(batch.column(0), batch.column(1), sizes))

    def gather(table: pa.Table) -> pa.Table:
        (key1, key2, sizes), places = _together(table)
        bits = np.zeros(int(sizes.sum()), bool)
        bits[places] = True
        parts = np.split(bits, np.cumsum(sizes)[:-1])
        return _per_text(key1, key2, [np.packbits(p).tobytes() if p.any() else b"" for p in parts])

    packed = docs.select("key1", "key2", "text").mapInArrow(send, _PACKED)
    return _exchanged(packed, buckets).applyInArrow(gather, _BITS).groupBy("key1", "key2").agg(F.first("found").alias("found"))


def covered_words(docs: DataFrame, symbols: DataFrame, buckets: int, rounds: int, window: int) -> DataFrame:
    """For each text with any, the spans of words that repeated windows cover, as flat 64-bit borders."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole, 2)):
            parse = Parse(Words(batch.column(2), IS_SPACED, False), rounds, edges=True)
            sizes = np.bincount(parse.text, minlength=batch.num_rows)
            shared = np.zeros(len(parse.names), bool)
            at = np.cumsum(sizes) - sizes
            for i, bits in enumerate(batch.column(3).to_pylist()):
                if bits:
                    shared[at[i] : at[i] + sizes[i]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(sizes[i]))
            begin = parse.possible(shared, window)
            names, checks = window_names(parse.words, begin, window)
            text = np.searchsorted(parse.words.first, begin, "right") - 1
            # Windows mostly follow each other: stretches of them are remembered.
            fresh = np.ones(len(begin), bool)
            fresh[1:] = (np.diff(begin) != 1) | (np.diff(text) != 0)
            first = np.flatnonzero(fresh)
            head = _head(batch.column(0), batch.column(1), text[first], begin[first] - parse.words.first[text[first]], np.diff(np.append(first, len(begin))))
            yield _packed(names, checks, buckets, head)

    def gather(table: pa.Table) -> pa.Table:
        (key1, key2, text, begin, size), places = _together(table)
        at = np.cumsum(size) - size
        stretch = np.searchsorted(at, places, "right") - 1
        start, owner = begin[stretch] + places - at[stretch], text[stretch]
        found = [b""] * len(key1)
        order = np.lexsort((start, owner))
        start, owner = start[order], owner[order]
        texts, first = np.unique(owner, return_index=True)
        for t, own in zip(texts.tolist(), np.split(start, first[1:]), strict=False):
            gap = np.flatnonzero(own[1:] > own[:-1] + window)
            spans = np.stack([own[np.concatenate([[0], gap + 1])], own[np.append(gap, len(own) - 1)] + window], axis=1)
            found[t] = spans.tobytes()
        return _per_text(key1, key2, found)

    packed = docs.join(symbols, ["key1", "key2"], "left").select("key1", "key2", "text", "found").mapInArrow(send, _PACKED)
    return _exchanged(packed, buckets).applyInArrow(gather, _BITS).groupBy("key1", "key2").agg(F.first("found").alias("found"))


def without_repeats(docs: DataFrame, window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, words, words removed, digest of the kept words and the removed spans of every row."""
    keyed = _keyed(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(partitions(docs.sparkSession), -(-int(size) // BUCKET_BYTES))
    symbols = written(shared_symbols(keyed, buckets, rounds), "symbols")
    covered = written(covered_words(keyed, symbols, buckets, rounds, window), "covered")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, digests, all_spans = [], [], [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                spans = np.frombuffer(found, np.int64).tolist() if found else []
                n.append(len(words))
                removed.append(sum(spans[1::2]) - sum(spans[::2]))
                for low, high in reversed(list(zip(spans[::2], spans[1::2], strict=True))):
                    del words[low:high]
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
                all_spans.append(spans)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(all_spans, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "removed_spans"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed_spans array<long>"
    return keyed.join(covered, ["key1", "key2"], "left").select("doc_id", "text", "found").mapInArrow(keep, schema)
