import random

import pytest
from pyspark.sql import functions as F

from acacia.llm import simhash
from tests.llm import brute


@pytest.mark.parametrize("parts", [1, 3])
def test_every_group_keeps_a_row_where_an_id_has_several_texts(spark, parts):
    rnd = random.Random(6)
    texts = [" ".join(f"{rnd.randrange(10**6)}" for _ in range(60)) for _ in range(4)]
    rows = [(1, texts[0], "x"), (1, texts[1], "x"), (2, texts[1], "x"), (1, texts[2], "x"), (3, texts[3], "x"), (4, texts[3], "x"), (1, texts[0], "x"), (None, texts[0], "x")]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts))
    want = [(1, texts[0]), (1, texts[1]), (1, texts[2]), (3, texts[3])]
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted(want)


@pytest.mark.parametrize("tile", [3, 1000])
def test_one_row_of_each_group(spark, tile):
    rnd = random.Random(7)
    texts = [" ".join(f"{rnd.randrange(10**6)}" for _ in range(30)) for _ in range(6)]
    long = [" ".join(f"{rnd.randrange(10**6)}" for _ in range(400)) for _ in range(3)]
    texts += long + [t + " end" for t in long] + [None, "", " \t"]
    rows = [(rnd.choice([None, *range(9)]), rnd.choice(texts), rnd.choice("ab"), rnd.randrange(2)) for _ in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `Text_Digest` string, print int").repartition(4)
    kept = [tuple(r) for r in simhash.one_of_each(docs, tile=tile).collect()]
    prints = brute.near_duplicates([r[:2] for r in rows])
    group = {}
    # Equal component ids may belong to several groups where an id has several texts: groups are told by their prints.
    parent = {p: p for _, p, _ in prints}
    for a in parent:
        for b in parent:
            if (int(a, 16) ^ int(b, 16)).bit_count() <= 4:
                low, high = sorted((parent[a], parent[b]))
                parent = {k: low if v == high else v for k, v in parent.items()}
    for row, (_, p, _) in zip(rows, prints):
        group.setdefault(parent[p], []).append(row)
    assert len(kept) == len(group)
    for own in group.values():
        least = min((r[0] for r in own if r[0] is not None), default=None)
        assert sum(r in own and r[0] == least for r in kept) == 1
    assert simhash.one_of_each(docs.limit(0)).count() == 0 and simhash.one_of_each(docs).columns == docs.columns


def test_rows_without_an_id_are_judged_too(spark):
    docs = spark.createDataFrame([(None, "a b c d e f")] * 3 + [(None, "g h i j k l")], "doc_id long, text string")
    assert sorted(r.text for r in simhash.one_of_each(docs).collect()) == ["a b c d e f", "g h i j k l"]
    assert simhash.one_of_each(docs.withColumn("m", F.create_map(F.lit("k"), F.lit(1)))).count() == 2
