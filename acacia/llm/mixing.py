"""Mixing sources to target weights by hierarchical budgeting.

Documents hang in a tree: domain, then language, then source. A token budget flows down from the
root: each node shares its budget among its children by their weights, and a child that cannot use
its share (its documents, repeated up to ``epochs`` times, have fewer tokens) passes the rest on to
its siblings, by weight; only what all siblings together cannot use stays with the parent, whose own
siblings were given it before. Each leaf then takes its tokens as a prefix of seeded epochs: every
epoch orders the leaf's documents by a seeded digest; whole epochs are taken as far as they fit, and
of the next one the documents that begin before the budget is used up.

The digest is that of a document's id and text, so that rows without ids, or with equal ones, are told apart by their
texts. Prefix sums are taken over digest ranges, 256 of a leaf at a time: the range where the prefix ends is cut into
256 again, and again; only the last range's documents are ordered one by one, so that no leaf has to be ordered
in one task. Rows equal in id and text are interchangeable: they are dealt into ``SALTS`` parts, counted there, and
numbered within their part alone.

A leaf's last document goes in whole, so that a leaf may exceed its budget by less than its longest document.

Defined cases: null texts have no tokens and null languages or sources count as ``""``; rows without
tokens are never taken; a null doc_id takes part like an empty id, and repeated rows are taken one by one, as many as the
budget has room for; texts are counted whole, however long; an empty table gives no rows; other columns,
whatever their names, are kept in ``mixed``. The children of one node are ordered in one task: sources of a
domain and language may be many thousands, but not a part of the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from acacia.llm.work import free_name, written

LEVELS = ("domain", "lang", "source")
#: Share of all tokens that is wanted, how often a document may be taken, and the seed of the orders.
FRACTION, EPOCHS, SEED = 0.5, 2, 17
#: Target weights by level; values that are not named have weight 1. Documented parameters.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 1}}
DOMAINS = 4
#: Hexadecimal digits of the digest by which ranges are cut, round by round.
RANGE_DIGITS = (2, 4, 6)
#: Parts into which rows of one digest are dealt.
SALTS = 1024


def domain_of(source: Column) -> Column:
    """The tables have no domain: sources are dealt into a few by the number at the end of their name."""
    number = F.regexp_extract(source, "[0-9]{1,9}$", 0)
    return F.concat(F.lit("d"), F.when(number == "", F.lit(0)).otherwise(number.try_cast("int") % DOMAINS).cast("string"))


def tokens_of(text: Column) -> Column:
    """Words between ASCII white space."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def _weight(level: str, weights: dict[str, dict[str, int]]) -> Column:
    out = F.lit(1)
    for name, weight in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(weight)).otherwise(out)
    return out.cast("double")


def shared_out(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """Adds ``take`` to children (capacity, weight, budget of their parent): budget by weight, with shortages going to the siblings.

    Children that a level of budget per weight fills are a prefix by capacity per weight; the others
    take that level times their weight.
    """
    order = [F.col("capacity") / F.col("weight"), F.col(key)]
    upto = Window.partitionBy(*parent).orderBy(*order) if parent else Window.partitionBy(F.lit(0)).orderBy(*order)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    rest = upto.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(rest)
    filled = children.withColumn("level", level).withColumn("filled", F.col("capacity") <= F.col("level") * F.col("weight"))
    highest = F.max(F.when(~F.col("filled"), F.col("level"))).over(whole)
    return filled.withColumn("take", F.when(F.col("filled"), F.col("capacity")).otherwise(highest * F.col("weight"))).drop("level", "filled")


def budgets(leaves: DataFrame, fraction: float, epochs: int, weights: dict[str, dict[str, int]]) -> DataFrame:
    """Leaves (domain, lang, source, tokens) with the tokens each may take."""
    nodes = leaves.where("tokens > 0")
    total = nodes.agg(F.floor(F.sum("tokens") * F.lit(float(fraction))).cast("double")).first()[0]
    above = None
    for depth, level in enumerate(LEVELS):
        parent, own = list(LEVELS[:depth]), list(LEVELS[: depth + 1])
        children = nodes.groupBy(*own).agg((F.sum("tokens") * epochs).cast("double").alias("capacity")).withColumn("weight", _weight(level, weights))
        if above is None:
            children = children.withColumn("budget", F.lit(total or 0.0))
        else:
            children = children.join(above, parent)
        above = shared_out(children, parent, level).select(*own, F.col("take").alias("budget"))
    return above.select(*LEVELS, F.floor(F.round("budget", 6)).cast("long").alias("budget"))


def ordered(epoch: Column, identity: Column, seed: int) -> Column:
    """The digest that orders a leaf's documents in an epoch."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), identity))


def _taken(docs: DataFrame, row: Column, fraction: float, epochs: int, weights: dict[str, dict[str, int]] | None, seed: int) -> DataFrame:
    """row, doc_id, domain, lang, source, tokens and copies of every row that is taken."""
    source = F.coalesce(F.col("source"), F.lit(""))
    identity = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5("text"))
    rows = docs.select(row.alias("row"), "doc_id", F.coalesce("lang", F.lit("")).alias("lang"), source.alias("source"), tokens_of(F.col("text")).alias("tokens"), identity.alias("identity"))
    rows = written(rows.withColumn("domain", domain_of(F.col("source"))).where("tokens > 0"), "tokens")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = budgets(leaves, fraction, epochs, WEIGHTS if weights is None else weights).join(leaves, list(LEVELS))
    plan = written(plan.select(*LEVELS, F.floor(F.col("budget") / F.col("tokens")).cast("int").alias("whole"), (F.col("budget") % F.col("tokens")).alias("rest")), "budgets")
    placed = rows.join(plan, list(LEVELS)).withColumn("digest", ordered(F.col("whole"), F.col("identity"), seed)).drop("identity")
    placed = written(placed.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS))), "placed")
    edges = plan.select(*LEVELS, "rest", F.lit(0).cast("long").alias("before"), F.lit("").alias("edge"))
    for digits in RANGE_DIGITS:
        # The first range in which the tokens exceed what is left: all before it are taken, and none after it.
        range_ = F.substring("digest", 1, digits)
        within = placed.drop("rest", "whole").join(edges, list(LEVELS)).where(F.col("digest").startswith(F.col("edge")))
        spans = within.groupBy(*LEVELS, range_.alias("span")).agg(F.sum("tokens").alias("span_tokens"), F.max("rest").alias("rest"), F.max("before").alias("offset"))
        upto = Window.partitionBy(*LEVELS).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
        spans = spans.withColumn("before", F.col("offset") + F.coalesce(F.sum("span_tokens").over(upto), F.lit(0)))
        ends = spans.where(F.col("before") + F.col("span_tokens") > F.col("rest")).groupBy(*LEVELS).agg(F.max("rest").alias("rest"), F.min(F.struct("span", "before")).alias("end"))
        edges = written(ends.select(*LEVELS, "rest", F.col("end.before").alias("before"), F.col("end.span").alias("edge")), "edges")
    met = placed.drop("rest").join(edges, list(LEVELS)).withColumn("span", range_)
    whole = met.where("span <> edge").withColumn("copies", F.col("whole") + (F.col("span") < F.col("edge")).cast("int"))
    edge = met.where("span = edge")
    part = [*LEVELS, "digest", "salt"]
    sums = edge.groupBy(*part).agg(F.sum("tokens").alias("part_tokens"), F.max("before").alias("offset"))
    upto = Window.partitionBy(*LEVELS).orderBy("digest", "salt").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("part_start", F.col("offset") + F.coalesce(F.sum("part_tokens").over(upto), F.lit(0))).drop("part_tokens", "offset")
    own = Window.partitionBy(*part).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.join(sums, part).withColumn("start", F.col("part_start") + F.coalesce(F.sum("tokens").over(own), F.lit(0)))
    edge = edge.withColumn("copies", F.col("whole") + (F.col("start") < F.col("rest")).cast("int"))
    out = ["row", "doc_id", *LEVELS, "tokens", "copies"]
    return whole.select(*out).unionByName(edge.select(*out)).where("copies > 0")


def selected(docs: DataFrame, fraction: float = FRACTION, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] | None = None, seed: int = SEED) -> DataFrame:
    """doc_id, domain, lang, source, tokens and copies of every document that is taken."""
    return _taken(docs, F.monotonically_increasing_id(), fraction, epochs, weights, seed).drop("row")


def mixed(docs: DataFrame, fraction: float = FRACTION, epochs: int = EPOCHS, weights: dict[str, dict[str, int]] | None = None, seed: int = SEED) -> DataFrame:
    """The documents taken, with all their columns and ``copies``."""
    copies, row = free_name("copies", docs.columns), free_name("row", docs.columns)
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # a row keeps its number if tasks are run again
    chosen = _taken(numbered, F.col(row), fraction, epochs, weights, seed).select(F.col("row").alias(row), F.col("copies").alias(copies))
    return numbered.join(chosen, row).drop(row)


#: DuckDB twin of ``selected`` with the parameters above.
def oracle(fraction: float = FRACTION, epochs: int = EPOCHS, seed: int = SEED) -> str:
    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
        return f"CAST(CASE {level} {cases} ELSE 1 END AS DOUBLE)"

    parts = [
        f"""rows_ AS (
  SELECT doc_id, letters, lang, source, tokens, concat('d', CASE WHEN regexp_extract(source, '[0-9]{{1,9}}$') = '' THEN 0 ELSE CAST(regexp_extract(source, '[0-9]{{1,9}}$') AS INT) % {DOMAINS} END) AS domain
  FROM (SELECT doc_id, md5(text) AS letters, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens FROM documents)
  WHERE tokens > 0
)""",
        f"take_ AS (SELECT CAST(floor(sum(tokens) * CAST({fraction} AS DOUBLE)) AS DOUBLE) AS take FROM rows_)",
    ]
    above = "take_"
    for depth, level in enumerate(LEVELS):
        own, parent = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        by = f"PARTITION BY {parent} " if parent else ""
        using = f"JOIN {above} USING ({parent})" if parent else f"CROSS JOIN {above}"
        parts += [
            f"c{depth} AS (SELECT {own}, CAST(sum(tokens) * {epochs} AS DOUBLE) AS capacity, {weight(level)} AS weight FROM rows_ GROUP BY {own})",
            f"""l{depth} AS (
  SELECT {own}, capacity, weight,
    (take - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c{depth} {using} WINDOW w AS ({by}ORDER BY capacity / weight, {level})
)""",
            f"""t{depth} AS (
  SELECT {own}, CASE WHEN capacity <= level * weight THEN capacity ELSE weight * max(CASE WHEN capacity > level * weight THEN level END) OVER ({by}) END AS take FROM l{depth}
)""",
        ]
        above = f"t{depth}"
    leaf = ", ".join(LEVELS)
    parts += [
        f"""plan_ AS (
  SELECT {leaf}, CAST(floor(CAST(round(take, 6) AS DOUBLE) / tokens) AS INT) AS whole, CAST(floor(round(take, 6)) AS BIGINT) % CAST(tokens AS BIGINT) AS rest
  FROM t2 JOIN (SELECT {leaf}, sum(tokens) AS tokens FROM rows_ GROUP BY {leaf}) USING ({leaf})
)""",
        f"placed AS (SELECT doc_id, {leaf}, tokens, whole, rest, md5(concat_ws(':', '{seed}', CAST(whole AS VARCHAR), coalesce(CAST(doc_id AS VARCHAR), ''), letters)) AS digest FROM rows_ JOIN plan_ USING ({leaf}))",
        f"summed AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY {leaf} ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM placed)",
    ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, {leaf}, tokens, whole + CAST(start < rest AS INT) AS copies FROM summed WHERE whole + CAST(start < rest AS INT) > 0"
