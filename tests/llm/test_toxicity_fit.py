"""The ordinal fit against a plain one, and grades and rejections against restatements."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from acacia.llm import toxicity


def cells(rnd, n=60, width=7):
    toxic = np.array([i % 2 for i in range(n)])
    row, column, count = [], [], []
    for i in range(n):
        for j in range(width):
            k = rnd.choice([0, 0, 1, 2]) + (rnd.choice([0, 1, 3]) if j < 2 and toxic[i] else 0)
            if k:
                row.append(i)
                column.append(j)
                count.append(k)
    return toxic, np.array(row), np.array(column), np.array(count, float)


def plain(x, target, balance, rounds=200_000, step=0.02):
    """Gradient descent, a row, a threshold and a feature at a time in spirit: no sparsity, momentum or tricks."""
    w, t = np.zeros(x.shape[1]), np.linspace(0, 1, target.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(t[None, :] - (x @ w)[:, None]))
        e = (p - target) * balance[:, None]
        w, t = w - step * (x.T @ e.sum(axis=1) + 1e-4 * w), t + step * e.sum(axis=0)
    return w, t


def setting(seed):
    toxic, row, column, count = cells(random.Random(seed))
    value = 1 + np.log(count)
    dense = np.zeros((len(toxic), 7))
    dense[row, column] = value
    grade = toxicity.grades_of(np.bincount(row, count * (column < 2), minlength=len(toxic)), toxic)
    target = np.stack([grade >= k for k in (1, 2, 3)], axis=1).astype(float)
    balance = np.full(len(toxic), 1 / len(toxic))
    return toxic, (row, column, value), dense, target, balance


@pytest.mark.parametrize("seed", [1, 2])
def test_weights_are_those_of_plain_descent(seed):
    _, features, dense, target, balance = setting(seed)
    w, t = toxicity._descend(features, 7, target, balance, 0.0, 20_000)
    w2, t2 = plain(dense, target, balance)
    assert np.allclose(w, w2, atol=0.02 * np.abs(w2).max()) and np.allclose(t, t2, atol=0.02 * np.abs(t2).max())


def test_penalised_weights_are_optimal():
    _, features, dense, target, balance = setting(3)
    penalty = 0.03
    w, t = toxicity._descend(features, 7, target, balance, penalty, 20_000)
    p = 1 / (1 + np.exp(t[None, :] - (dense @ w)[:, None]))
    slope = dense.T @ ((p - target) * balance[:, None]).sum(axis=1) + 1e-4 * w
    assert (w == 0).any() and (w != 0).any()
    assert np.all(np.abs(slope[w == 0]) <= penalty + 1e-4) and np.allclose(slope[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-4)


def test_grades_are_thirds_by_marking_words():
    hits, toxic = np.array([0, 9, 1, 2, 3, 4, 5, 6, 7]), np.array([0, 0, 1, 1, 1, 1, 1, 1, 1])
    grades = toxicity.grades_of(hits, toxic)
    assert grades.tolist()[:2] == [0, 0] and sorted(grades.tolist()[2:]) == grades.tolist()[2:] and Counter(grades.tolist()[2:]) == {1: 3, 2: 2, 3: 2}


def test_cut_is_the_best_of_all():
    rnd = random.Random(4)
    for _ in range(20):
        toxic = np.array([rnd.randrange(2) for _ in range(40)] + [0, 1])
        chance = np.array([min(0.95, max(0.05, 0.4 + 0.2 * y + rnd.gauss(0, 0.15))) for y in toxic]).round(2)

        def gap(cut):
            return (chance[toxic == 1] >= cut).mean() - (chance[toxic == 0] >= cut).mean()

        best = max(gap(c) for c in np.unique(chance)[1:])
        assert gap(toxicity.best_cut(chance, toxic)) == pytest.approx(best)


def test_scores_against_brute_force(spark):
    model = toxicity.Ordinal({b"awful": 1.5, b"^nast": 0.7, b"fine": -2.0}, [0.5, 1.0, 2.5], 0.4)
    texts = [None, "", "Awful awful, AWFUL", "nasty nastier nast", "fine awful\0fine", "é awful" * 3, "x " * 5000 + "awful"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in toxicity.scored(docs, model).collect():
        words = ["".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in (texts[r.doc_id] or "").lower())][0].split()
        n = {"awful": words.count("awful"), "fine": words.count("fine"), "^nast": sum(len(w) > 4 and w.startswith("nast") for w in words)}
        z = sum(w * (1 + math.log(n[k])) for k, w in (("awful", 1.5), ("^nast", 0.7), ("fine", -2.0)) if n[k])
        reach = [1 / (1 + math.exp(t - z)) for t in model.thresholds]
        assert (r.severity, r.p_toxic, r.rejected) == (pytest.approx(sum(reach), abs=1e-8), pytest.approx(reach[0]), reach[0] >= 0.4)


def test_sample_is_bounded_by_texts(spark):
    docs = spark.createDataFrame([(i % 3, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 0)], "doc_id long, toxic int")
    assert toxicity.sample(docs, labels, 20).count() == 20 and toxicity.sample(docs, labels, 2).count() == 2


def test_sample_is_the_smallest_digests(spark):
    texts = [f"text {i % 30}" for i in range(60)] + ["", None]
    docs = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 0), (3, 1), (3, None)], "doc_id long, toxic int")
    flags = {}
    for i, t in enumerate(texts):
        flags[(t or "").encode()] = max(flags.get((t or "").encode(), 0), int(i % 4 in (1, 3)))
    expected = {t: flags[t] for t in sorted(flags, key=lambda t: hashlib.sha256(t).hexdigest())[:12]}
    rows = toxicity.sample(docs, labels, 12).collect()
    assert {bytes(r["text"]): r["toxic"] for r in rows} == expected and len({r["row"] for r in rows}) == len(rows) == 12


def test_held_out_labels(spark):
    """Fitted on half of the labels of the given table, the model tells the other half apart."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    model = toxicity.fit(docs, labels.where(half == 0))
    seen = labels.where("toxic is not null").where(half == 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    found = toxicity.scored(docs, model).join(seen, "doc_id").groupBy("toxic").agg(F.avg(F.col("rejected").cast("int")).alias("rate"), F.avg("severity").alias("severity"), F.count("*").alias("n"))
    rate = {r["toxic"]: r for r in found.collect()}
    assert rate[1]["n"] > 20 and rate[0]["n"] > 20
    assert rate[1]["rate"] >= 0.8 and rate[0]["rate"] <= 0.1 and rate[1]["severity"] > 2 * rate[0]["severity"], rate
