"""Exact top-k inner products by distributed histogram selection.

Query vectors go out in blocks of bounded rows and bytes. For a block, every candidate is scored in Arrow
batches with a matrix product; the scores are never stored. Their k-th value is located by
narrowing: each round counts scores by the next higher bits inside the interval found so far, the
counts are added up over all tasks, and the bin that holds the k-th value becomes the next interval.
The last round keeps the scores at or above that value, and ties go to smaller ids.

A task reports only counts at or above its own k-th value: the global one cannot lie lower.

Defined cases: vectors that are null or hold a null, infinite or NaN component, and rows without a
vec_id, take no part; vectors of different lengths are not compared; a query's candidates are the
rows with another vec_id, so that a repeated row is no candidate of its own copies; a query row that is
repeated is answered once for each row; scores beyond 64 bits, which a score of type long can't hold, count
as the nearest one that it can; no candidates give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from acacia.llm.work import written

#: Query vectors of one pass over the candidates, their bytes, and the bits by which a round narrows.
QUERY_BLOCK, QUERY_BYTES, BITS = 16_384, 32 << 20, 13
_EXACT = 1 << 52


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and components of the rows that take part."""
    x = F.col("embedding")
    whole = (F.col("vec_id").isNotNull()) & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != F.lit(float("inf"))))
    return vectors.where(whole).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("v")
    )


def _matrices(ids: pa.Array, vectors: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and scaled, floored vectors, one matrix for each vector length."""
    ids = np.asarray(ids)
    values = np.floor(np.asarray(vectors.flatten(), np.float64) * scale)
    sizes = np.asarray(vectors.value_lengths())
    ends = np.cumsum(sizes)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        at = (ends[rows] - size)[:, None] + np.arange(size)[None, :]
        yield ids[rows], values[at] if size else np.zeros((len(rows), 0))


def _scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact integer products; clipped to 64 bits where they could not be held."""
    reach = (np.abs(queries).max(initial=0.0)) * (np.abs(candidates).max(initial=0.0)) * max(1, queries.shape[1])
    if reach < _EXACT:
        return np.rint(queries @ candidates.T).astype(np.int64)
    q, c = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (queries, candidates))
    exact = q.dot(c.T) if queries.shape[1] else np.zeros((len(q), len(c)), object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, block: int = QUERY_BLOCK, bits: int = BITS) -> DataFrame:
    """query_id, rank, vec_id and score of each query's ``k`` best candidates."""
    spark = vectors.sparkSession
    candidates = usable(vectors)
    wanted = usable(queries)
    n, values = wanted.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    parts = max(1, -(-n // block), -(-8 * values // QUERY_BYTES))
    largest = candidates.agg(F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))), F.max(F.size("v"))).first()
    bound = (float(largest[0] or 0.0) * scale + 1) * max(1, int(largest[1] or 1))
    out = None
    numbered = written(wanted.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts))), "queries")
    for part in range(parts):
        rows = numbered.where(F.col("part") == part).select("vec_id", "v").toArrow()  # about `block` rows
        found = _one_block(candidates, rows, k, scale, bits, bound)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")


def _one_block(candidates: DataFrame, rows: pa.Table, k: int, scale: float, bits: int, bound: float) -> DataFrame:
    """The best candidates of some queries. ``bound``: the largest component of any candidate times their length."""
    spark = candidates.sparkSession
    groups = list(_matrices(rows["vec_id"].combine_chunks(), rows["v"].combine_chunks(), scale)) if rows.num_rows else []
    by_size, base = {}, 0
    for ids, matrix in groups:
        by_size[matrix.shape[1]] = (base, ids, matrix)
        base += len(ids)
    total = base
    shared = spark.sparkContext.broadcast(by_size)  # bounded by the block size

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """First query number, candidate ids, scores, and whether each pair counts."""
        for batch in batches:
            for ids, matrix in _matrices(batch.column(0), batch.column(1), scale):
                if matrix.shape[1] in shared.value:
                    first, own, q = shared.value[matrix.shape[1]]
                    step = max(1, (1 << 22) // max(1, len(ids)))
                    for low in range(0, len(own), step):
                        s = _scores(q[low : low + step], matrix)
                        yield first + low, ids, s, own[low : low + step, None] != ids[None, :]

    def counted(shift: int, above: np.ndarray, below: np.ndarray):
        """Counts of (score >> shift) for scores in [above, below) of each query."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for first, _, s, counts in scored(batches):
                binned = s >> shift
                low, high = above[first : first + len(s), None], below[first : first + len(s), None]
                counts &= (s >= low) & (s <= high)
                lines, bins, sums = [], [], []
                for i in range(len(s)):
                    own = binned[i][counts[i]]
                    if len(own) > k:
                        own = own[own >= np.partition(own, len(own) - k)[len(own) - k]]
                    values, n = np.unique(own, return_counts=True)
                    lines.append(np.full(len(values), first + i))
                    bins.append(values)
                    sums.append(n)
                arrays = [pa.array(np.concatenate(x).astype(np.int64)) for x in (lines, bins, sums)]
                yield pa.RecordBatch.from_arrays(arrays, ["query", "bin", "n"])

        return run

    low = np.full(total, -(1 << 63), np.int64)
    high = np.full(total, (1 << 63) - 1, np.int64)
    need = np.full(total, k, np.int64)
    # A first bound on all scores decides how many bits there are to narrow.
    own = max((float(np.abs(m).max(initial=0.0)) for _, m in groups), default=0.0)
    reach = bound * (own + 1)
    shift = max(0, min(63, int(np.ceil(np.log2(reach + 1))) + 1) - bits)
    while total:
        rounds = candidates.mapInArrow(counted(shift, low, high), "query long, bin long, n long")
        sums = rounds.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query").orderBy(F.desc("bin"))
        running = sums.withColumn("upto", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        wanted = spark.createDataFrame(pa.table({"q": np.arange(total), "need": need}))
        at = running.join(wanted, F.col("query") == F.col("q")).where("upto >= need").groupBy("query").agg(F.max_by(F.struct("bin", "n", "upto"), "bin").alias("hit"))
        found = at.select("query", "hit.*").toArrow()  # a row for each query of the block
        q = np.asarray(found["query"])
        bin_, n, upto = (np.asarray(found[c]) for c in ("bin", "n", "upto"))
        short = np.ones(total, bool)
        short[q] = False  # fewer than k candidates: all of them are kept
        need[q] -= upto - n
        low[q] = np.maximum(low[q], bin_ << shift)
        high[q] = np.minimum(high[q], (bin_ << shift) + ((1 << shift) - 1))
        low[short], high[short] = -(1 << 63), -(1 << 63)
        if shift == 0:
            break
        shift = max(0, shift - bits)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, ids, s, counts in scored(batches):
            i, j = np.nonzero(counts & (s >= low[first : first + len(s), None]))
            owners = np.concatenate([g[0] for g in groups])
            arrays = [pa.array(first + i), pa.array(owners[first + i]), pa.array(ids[j]), pa.array(s[i, j])]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "query_id", "vec_id", "score"])

    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return (
        candidates.mapInArrow(kept, "row long, query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(best).cast("int"))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
