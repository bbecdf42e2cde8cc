from pyspark.sql import functions as F

from acacia.llm import mixing

DOCS = "doc_id long, text string, lang string, source string"


def test_rows_without_an_id_stay(spark):
    docs = spark.createDataFrame([(None, "a b c", "en", "src0"), (None, " ", "en", "src0"), (1, "d e", "en", "src0"), (None, "f", None, None)], DOCS)
    kept = mixing.mixed(docs, fraction=2.0, epochs=2).collect()
    assert sorted((r.doc_id or 0, r.text, r.copies) for r in kept) == [(0, "a b c", 2), (0, "f", 2), (1, "d e", 2)]


def test_copies_stay_in_their_leaf(spark):
    rows = [(i, f"{lang} words {i}", lang, f"src{s}") for i in range(40) for lang in ("en", "de", "fr") for s in range(3)]
    docs = spark.createDataFrame(rows, DOCS)
    key = ["doc_id", "lang", "source", "copies"]
    chosen = sorted(tuple(r) for r in mixing.selected(docs).select(*key).collect())
    assert sorted(tuple(r) for r in mixing.mixed(docs).select(*key).collect()) == chosen
    assert mixing.mixed(docs).where(F.col("text") == F.concat_ws(" ", "lang", F.lit("words"), "doc_id")).count() == len(chosen)


def leaf_budgets(docs):
    """Each leaf's budget and longest document."""
    rows = docs.select(mixing.domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), mixing.tokens_of(F.col("text")).alias("tokens"))
    leaves = rows.groupBy(*mixing.LEVELS).agg(F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"))
    plan = mixing.budgets(leaves, mixing.FRACTION, mixing.EPOCHS, mixing.WEIGHTS)
    return {tuple(r[:3]): (r["budget"], r["longest"]) for r in plan.join(leaves, list(mixing.LEVELS)).collect()}


def within_a_document(docs):
    want = leaf_budgets(docs)
    got = mixing.selected(docs).groupBy(*mixing.LEVELS).agg(F.sum(F.col("tokens") * F.col("copies")).alias("taken")).collect()
    for r in got:
        budget, longest = want[tuple(r[:3])]
        assert budget <= r["taken"] < budget + longest
    assert got and {tuple(r[:3]) for r in got} == {k for k, (budget, _) in want.items() if budget}


def test_rows_without_ids_keep_the_budget(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    within_a_document(docs)
    within_a_document(docs.withColumn("doc_id", F.lit(None).cast("long")))


def test_repeated_rows_keep_the_budget(spark):
    """Thousands of rows equal in all columns, and as many that share an id, in a leaf with others."""
    same = [(7, "same text here", "en", "src0")] * 3000
    shared = [(8, f"words of row {i}", "en", "src1") for i in range(500)]
    docs = spark.createDataFrame(same + shared + [(i, "a b", "de", "src0") for i in range(50)], DOCS).repartition(7)
    within_a_document(docs)
    chosen, kept = mixing.selected(docs), mixing.mixed(docs)
    total = [df.agg(F.sum("copies")).first()[0] for df in (chosen, kept)]
    assert total[0] == total[1] and chosen.count() == kept.count() < docs.count()
