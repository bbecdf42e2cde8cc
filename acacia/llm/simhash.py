"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are made in Arrow batches. Distinct fingerprints are dealt into tiles of equal
population count, and large counts are cut by the counts of their 16-bit quarters; two tiles meet only if
their counts, and the boxes of their quarters' counts, differ by no more than the radius, and inside a
meeting numpy compares whole blocks with exclusive-or and bit counts, again skipping the blocks whose
quarters' counts differ beyond the radius. Each meeting hands on a spanning forest of the links it found
(not all pairs), and star contraction joins the forests.

The number of comparisons grows with the square of the distinct fingerprints; what is shipped for
one meeting is bounded by ``TILE``.

Defined cases: null or wordless texts have fingerprint zero and link like any other; a null doc_id
gets the component of its fingerprint but is never a component's smallest id; repeated rows are
returned as often as they come (``one_of_each`` keeps one of them); a text is hashed whole, at some 64
bytes of a task's memory a word; an empty table gives no rows; other columns are ignored, or kept by
``one_of_each`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acacia.llm.work import free_name, written
from acacia.operators.components import connected

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Fingerprints in a tile at most (on average, where a population count needs several tiles).
TILE = 32_768


def shingle_hashes(text: bytes, k: int = SHINGLE, seed: int = SEED) -> list[int]:
    """XXH64 of each run of ``k`` words, joined by spaces; of all words if there are fewer."""
    words = text.lower().split()  # for bytes: A-Z only, and exactly the six ASCII white-space characters
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return [digest(joined, seed)]
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(words) - k + 1].tolist()
    return [digest(joined[a:b], seed) for a, b in zip(start, end[k - 1 :].tolist(), strict=True)]


def _votes(hashes: list[int], counts: list[int]) -> np.ndarray:
    """A fingerprint for each group of hashes: a bit is set if over half of the group have it."""
    n = np.asarray(counts, np.int64)
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        starts = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > n[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints_of(texts: list[bytes | None], k: int = SHINGLE, seed: int = SEED, piece: int = 60_000) -> np.ndarray:
    out: list[np.ndarray] = []
    hashes: list[int] = []
    counts: list[int] = []
    for text in texts:
        own = shingle_hashes(text or b"", k, seed)
        hashes += own
        counts.append(len(own))
        if len(hashes) >= piece:
            out.append(_votes(hashes, counts))
            hashes, counts = [], []
    out.append(_votes(hashes, counts))
    return np.concatenate(out)


def fingerprints(docs: DataFrame, k: int = SHINGLE, seed: int = SEED, more: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, its fingerprint as a signed 64-bit integer, and ``more`` columns."""
    read = docs.select(F.col("text").cast("binary").alias("text"), F.col("doc_id").cast("long").alias("doc_id"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = fingerprints_of(batch.column(0).to_pylist(), k, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(prints)], [*batch.schema.names[1:], "print"])

    return read.mapInArrow(run, T.StructType([*read.schema.fields[1:], T.StructField("print", T.LongType())]))


def _quarters(prints: np.ndarray) -> np.ndarray:
    return np.bitwise_count(prints.view("<u2").reshape(-1, 4)).astype(np.int16)


def _grouped(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints sorted by the population counts of their quarters, the distinct counts, and each group's border."""
    q = _quarters(prints)
    key = ((q[:, 0] * 17 + q[:, 1]).astype(np.int64) * 17 + q[:, 2]) * 17 + q[:, 3]
    order = np.argsort(key, kind="stable")
    _, first = np.unique(key[order], return_index=True)
    return prints[order], q[order][first], np.append(first, len(prints))


def linked(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS, block: int = 1 << 21) -> np.ndarray:
    """Pairs (root, member) that connect all of ``a`` and ``b`` (``a`` itself if None) that link; a spanning forest."""
    left, left_counts, left_at = _grouped(a)
    right, right_counts, right_at = (left, left_counts, left_at) if b is None else _grouped(b)
    nodes = left if b is None else np.concatenate([left, right])
    shift = 0 if b is None else len(left)
    label = np.arange(len(nodes))

    def union(x: np.ndarray, y: np.ndarray) -> None:
        lx, ly = label[x], label[y]
        new = lx != ly
        if not new.any():
            return
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while (p := parent.get(v, v)) != v:
                parent[v] = parent.get(p, p)
                v = p
            return v

        for p, q in set(zip(lx[new].tolist(), ly[new].tolist(), strict=True)):
            p, q = root(p), root(q)
            if p != q:
                parent[max(p, q)] = min(p, q)
        moved = np.arange(len(nodes))
        for v in list(parent):
            moved[v] = root(v)
        label[:] = moved[label]

    for g in range(len(left_at) - 1):
        near = np.flatnonzero(np.abs(right_counts - left_counts[g]).sum(axis=1) <= radius)
        if b is None:
            near = near[near >= g]
        if not len(near):
            continue
        sizes = right_at[near + 1] - right_at[near]
        index = np.repeat(right_at[near] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        other = right[index]
        rows = max(1, block // len(other))
        for low in range(int(left_at[g]), int(left_at[g + 1]), rows):
            own = left[low : min(low + rows, int(left_at[g + 1]))]
            x, y = np.nonzero(np.bitwise_count(own[:, None] ^ other[None, :]) <= radius)
            if len(x):
                union(x + low, index[y] + shift)
    members = np.flatnonzero(label != np.arange(len(nodes)))
    return np.stack([nodes[label[members]], nodes[members]], axis=1)


def _cut(counts: dict[tuple[int, ...], int], tile: int) -> list[tuple[int, ...]]:
    """Counts of quarters with the number of their first tile and of their tiles; small neighbours of one population count share a tile."""
    out: list[tuple[int, ...]] = []
    number, held, last = -1, 0, -1
    for q in sorted(counts, key=lambda q: (sum(q), q)):
        parts = -(-counts[q] // tile)
        if parts > 1 or sum(q) != last or held + counts[q] > tile:
            number, held = number + 1, 0
        out.append((*q, number, parts))
        number, held, last = number + parts - 1, tile if parts > 1 else held + counts[q], sum(q)
    return out


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints (column print) to edges (a, b) whose components are those of all links."""
    spark = nodes.sparkSession
    names = ["q0", "q1", "q2", "q3"]
    split = nodes.select("print", *[F.bit_count(F.shiftrightunsigned("print", 16 * i).bitwiseAND(F.lit(0xFFFF))).cast("int").alias(q) for i, q in enumerate(names)])
    counts = {tuple(r[q] for q in names): r["n"] for r in split.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()}  # 17**4 rows at most
    if not counts:
        return spark.createDataFrame([], "a long, b long")
    cut = spark.createDataFrame(_cut(counts, tile), ", ".join(f"{q} int" for q in names) + ", first int, parts int")
    tiles = cut.select(*names, F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("tile"))
    tiles = tiles.groupBy("tile").agg(F.min(sum(F.col(q) for q in names)).alias("ones"), *[f(q).alias(f"{s}{q}") for q in names for s, f in (("low_", F.min), ("high_", F.max))])
    other = tiles.select(*[F.col(c).alias(f"{c}2") for c in tiles.columns])
    reach = tiles.withColumn("to", F.explode(F.sequence(F.col("ones"), F.col("ones") + radius)))
    apart = sum(F.greatest(F.col(f"low_{q}") - F.col(f"high_{q}2"), F.col(f"low_{q}2") - F.col(f"high_{q}"), F.lit(0)) for q in names)
    meetings = reach.join(other, F.col("to") == F.col("ones2")).where((F.col("tile") <= F.col("tile2")) & (apart <= radius)).select("tile", "tile2")
    meeting = F.xxhash64("tile", "tile2").alias("meeting")
    sides = meetings.select("tile", meeting, F.lit(0).alias("side")).unionByName(meetings.where("tile <> tile2").select(F.col("tile2").alias("tile"), meeting, F.lit(1).alias("side")))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, key = np.asarray(batch.column(0)).view(np.uint64), np.asarray(batch.column(1))
            order = np.argsort(key, kind="stable")
            found, first = np.unique(key[order], return_index=True)
            packed = [x.tobytes() for x in np.split(own[order], first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(packed[: len(found)], pa.binary())], ["tile", "prints"])

    dealt = split.join(F.broadcast(cut), names).select("print", (F.col("first") + F.pmod(F.xxhash64("print"), "parts").cast("int")).alias("tile"))
    packed = dealt.mapInArrow(pack, "tile int, prints binary")

    def meet(table: pa.Table) -> pa.Table:
        side = np.asarray(table["side"])
        blobs = table["prints"].to_pylist()
        first, second = (np.frombuffer(b"".join(x for x, s in zip(blobs, side, strict=True) if s == k), np.uint64) for k in (0, 1))
        pairs = linked(first, second if (side == 1).any() else None, radius).view(np.int64)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return packed.join(sides, "tile").select("meeting", "side", "prints").groupBy("meeting").applyInArrow(meet, "a long, b long")


def _classes(docs: DataFrame, radius: int, tile: int, more: tuple[Column, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """doc_id, print and ``more`` of every row; and of every print (node) its group's root and component_id."""
    prints = written(fingerprints(docs, more=more), "prints")
    nodes = written(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "nodes")
    roots = written(connected(links(nodes.select("print"), radius, tile)).withColumnRenamed("node", "print"), "roots")
    whole = roots.unionByName(roots.select(F.col("root").alias("print"), "root")).distinct()
    known = whole.join(nodes, "print")
    smallest = written(known.groupBy("root").agg(F.min("least").alias("component_id")), "smallest")
    linked_prints = written(whole.join(smallest, "root").select("print", "root", "component_id"), "linked")
    final = written(
        nodes.join(linked_prints, "print", "left").select(F.col("print").alias("node"), F.coalesce("root", "print").alias("root"), F.coalesce("component_id", "least").alias("component_id")),
        "classes",
    )
    return prints, final


def near_duplicates(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints, final = _classes(docs, radius, tile)
    return prints.join(final, F.col("print") == F.col("node")).select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates: that of the smallest doc_id, rows without one last, then of the smallest digest.

    Rows are told apart by all their columns; of rows that are equal in all of them, any is kept.
    """
    names = {k: free_name(k, docs.columns) for k in ("text_digest", "row_hash")}
    # A null text is not an empty one, but both have fingerprint zero.
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias(names["text_digest"])
    rest = F.to_json(F.struct(F.col("text").isNull().alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text"]))
    key = (digest, F.xxhash64(rest).alias(names["row_hash"]))
    prints, final = _classes(docs, radius, tile, key)
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", *names.values())
    kept = prints.join(final, F.col("print") == F.col("node")).groupBy("root").agg(F.min(order).alias("k"))
    kept = written(kept.select(*[F.col(f"k.{n}").alias(n) for n in names.values()]), "kept")
    copies = prints.groupBy(*names.values()).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*names.values())
    repeated = written(kept.join(copies, list(names.values()), "left_semi"), "repeated")
    rows = docs.select("*", *key)
    once = rows.join(kept.join(repeated, list(names.values()), "left_anti"), list(names.values()), "left_semi")
    if not repeated.isEmpty():
        once = once.unionByName(rows.join(repeated, list(names.values()), "left_semi").dropDuplicates(list(names.values())))
    return once.drop(*names.values())
