"""Connected components of graphs and rasters of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acacia.operators.clusters import pixel_components
from acacia.operators.work import written


def connected(edges: DataFrame) -> DataFrame:
    """Edges (a, b) to (node, root), where root is the component's smallest node.

    Each round hangs every larger neighbour of a node, and then the node itself, below the smallest one
    that the node knows; the number of rounds grows with the logarithm of the longest path.
    """
    now = written(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")), "least").select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        high = written(both.join(least, F.col("a") == F.col("n")).where("b > a and m <> b").select(F.col("m").alias("a"), "b").distinct(), "high")
        least = written(high.groupBy("b").agg(F.min("a").alias("m")), "least").select(F.col("b").alias("n"), "m")
        met = high.join(least, F.col("b") == F.col("n"))
        new = written(met.select(F.col("m").alias("a"), "b").unionByName(met.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct(), "new")
        # The edges of two rounds are equal when their number and two sums of hashes are.
        hashes = [F.sum(F.xxhash64(F.lit(i), "a", "b").cast("decimal(20, 0)")) for i in (0, 1)]
        after = tuple(new.agg(F.count(F.lit(1)), *hashes).first())
        if after == before or not after[0]:
            return new.select(F.col("b").alias("node"), F.col("a").alias("root"))
        now, before = new, after


def large_raster(pixels: DataFrame, by: list[str], block: int = 1024, corners: bool = False) -> DataFrame:
    """Pixels (by, r, c, value) with ``component``, which is not cut at block borders.

    Blocks are labelled one by one; labels that meet across a border are edges of a graph whose
    components join them. A task holds a block, whatever the raster's size.
    """
    blocked = pixels.select(*by, "r", "c", "value", F.floor(F.col("r") / block).cast("int").alias("block_r"), F.floor(F.col("c") / block).cast("int").alias("block_c"))
    labelled = pixel_components(blocked, [*by, "block_r", "block_c"], corners)
    labelled = written(labelled.withColumn("label", F.concat_ws(":", *by, "block_r", "block_c", "component")).drop("component"), "labelled")
    steps = [(1, 0), (0, 1), *([(1, 1), (1, -1)] if corners else [])]
    step = F.explode(F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in steps]))
    edge = labelled.where((F.pmod("r", F.lit(block)).isin(0, block - 1)) | (F.pmod("c", F.lit(block)).isin(0, block - 1)))
    ahead = edge.select(*by, "r", "c", F.col("label").alias("a"), step.alias("s")).select(*by, (F.col("r") + F.col("s.y")).alias("r"), (F.col("c") + F.col("s.x")).alias("c"), "a")
    met = ahead.join(edge.select(*by, "r", "c", F.col("label").alias("b")), [*by, "r", "c"]).where("a <> b").select("a", "b").distinct()
    roots = connected(met)
    out = labelled.join(roots, F.col("label") == F.col("node"), "left")
    return out.select(*by, "r", "c", "value", F.coalesce("root", "label").alias("component"))
