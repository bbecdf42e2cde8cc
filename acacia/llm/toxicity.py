"""Toxicity by cumulative-link ordinal regression.

Severity has ordered grades: 0 for documents labelled clean, and 1 to 3 for documents labelled
toxic, by thirds of the number of words in them that mark the toxic class. The model has one weight
for each feature, shared by all thresholds, and one threshold for each grade above 0:
``P(grade >= k) = sigmoid(weights . x - threshold_k)``. Words and beginnings of words are the
features, with value ``1 + ln(count)``; proximal gradient steps with an L1 penalty keep few of them.
A document's expected severity is the sum of ``P(grade >= k)``. It is rejected from that
``P(grade >= 1)`` on which tells the classes of the sample apart best (the rates of toxic and clean
documents that reach it differ most).

The labels say only toxic or not, so a grade above 0 means how much of a document marks the class, and not
how severe a reader would find it; expected severity orders documents by that. P(grade >= 1), on which
rejection rests, doesn't depend on how toxic documents are graded among themselves but through shared weights.

The model is fitted on a sample of labelled documents of at most ``SAMPLE`` distinct texts, chosen by
the hash of their ids and then of their texts, and on at most ``FEATURES`` words and beginnings, those of the
steepest slopes (documented bounds of the fit); every document is scored.

Defined cases: null texts are empty; texts without known words get the severity of the thresholds
alone; texts are read whole, in a task's memory, however long they are; labels that are null, or have no
document, are left out, and of several labels of an id the toxic one counts; without labels of both classes
nothing is rejected and severity is 0; repeated rows are scored one by one; an empty table gives no rows;
other columns are kept in ``clean`` and ignored in ``scored``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acacia.llm.words import ALNUM_TABLE
from acacia.llm.work import partitions, written

SAMPLE, FEATURES, GRADES = 10_000, 50_000, 3
#: L1 penalty on the weights of scaled features while words are chosen.
PENALTY = 0.06
#: Words and beginnings in fewer sampled documents than this are no features.
LEAST_DOCUMENTS = 4


#: Bytes of a word that make a beginning, which is a feature of its own: inflected words share it.
BEGINNINGS = (4, 5, 6)
_MARK = b"^"  # no word has it


def features(text: bytes) -> Counter:
    """How often each word, and each beginning of a longer word, is in a text."""
    words = Counter(text.translate(ALNUM_TABLE).split())
    out = Counter(words)
    for word, n in words.items():
        for k in BEGINNINGS:
            if len(word) <= k:
                break
            out[_MARK + word[:k]] += n
    return out


@dataclass
class Ordinal:
    weights: dict[bytes, float]
    thresholds: list[float]
    cut: float = 0.5

    def __post_init__(self) -> None:
        self.begun = [(k, {w[1:]: w for w in self.weights if w[:1] == _MARK and len(w) == k + 1}) for k in BEGINNINGS]
        self.begun = [(k, known) for k, known in self.begun if known]

    def reach(self, text: bytes | None) -> list[float]:
        """P(grade >= k) for k from 1 on."""
        if not self.thresholds:
            return []
        counts: dict[bytes, int] = {}
        for word, n in Counter((text or b"").translate(ALNUM_TABLE).split()).items():
            if word in self.weights:
                counts[word] = counts.get(word, 0) + n
            for k, known in self.begun:
                if len(word) > k and (name := known.get(word[:k])) is not None:
                    counts[name] = counts.get(name, 0) + n
        z = sum(self.weights[w] * (1 + math.log(n)) for w, n in counts.items())
        return [1 / (1 + math.exp(max(-500.0, min(500.0, t - z)))) for t in self.thresholds]


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Texts and toxic flags of labelled documents, written; repeated texts once; ``most`` documents at most."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("text").agg((F.max("toxic") > 0).cast("int").alias("toxic"))  # chosen is bounded
    rows = rows.withColumn("key", F.sha2("text", 256)).repartition(partitions(docs.sparkSession), "key")
    stored = written(rows.select(F.monotonically_increasing_id().alias("row"), "key", "text", "toxic"), "sample")
    # An id may have several texts. Digests alone, and no texts, pass through the one task that a limit ends in.
    within = stored.select("key").orderBy("key").limit(most)
    return stored.join(F.broadcast(within), "key").select("row", "text", "toxic")  # at most ``most`` digests


def counted(rows: DataFrame, words: list[bytes]) -> DataFrame:
    """row, word and count of some features in the sample."""
    known = frozenset(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], []]
            for row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for word, n in features(text).items():
                    if word in known:
                        for column, x in zip(columns, (row, word, n), strict=True):
                            column.append(x)
            kinds = (pa.int64(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "word", "n"])

    return rows.select("row", "text").mapInArrow(run, "row long, word binary, n long")


_SUMS = "word binary, slope double, square double, with_toxic long, with_clean long"


def screened(rows: DataFrame, sizes: dict[int, int], penalty: float) -> tuple[list[bytes], list[bool]]:
    """Features whose scaled slope at zero reaches half the penalty, and whether they mark the toxic class."""
    half = {y: 0.5 / n for y, n in sizes.items()}  # the classes weigh the same

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[bytes, list] = {}
            for toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for word, n in features(text).items():
                    row = sums.setdefault(word, [0.0, 0.0, 0, 0])
                    value = 1 + math.log(n)
                    row[0] += half[toxic] * value * (0.5 - toxic)
                    row[1] += half[toxic] * value * value
                    row[2 if toxic else 3] += 1
            kinds = (pa.float64(), pa.float64(), pa.int64(), pa.int64())
            columns = [pa.array(list(sums), pa.binary()), *(pa.array([v[i] for v in sums.values()], k) for i, k in enumerate(kinds))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _SUMS.split(", ")])

    sums = rows.select("toxic", "text").mapInArrow(run, _SUMS).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("slope", "square", "with_toxic", "with_clean")])
    marks = F.col("with_toxic") / sizes[1] > 4 * (F.col("with_clean") + 1) / sizes[0]
    steep = F.abs(F.col("slope")) / F.sqrt("square")
    found = sums.where(F.col("with_toxic") + F.col("with_clean") >= LEAST_DOCUMENTS).where(steep >= penalty / 2).orderBy(F.desc(F.round(steep, 9)), "word").limit(FEATURES)
    kept = sorted(found.select("word", marks.alias("marks")).collect())
    return [bytes(r["word"]) for r in kept], [r["marks"] for r in kept]


def grades_of(hits: np.ndarray, toxic: np.ndarray, grades: int = GRADES) -> np.ndarray:
    """Severity grades: toxic documents by how many of their words mark the class."""
    out = np.zeros(len(toxic), np.int64)
    at = np.flatnonzero(toxic)
    if len(at):
        cuts = np.quantile(hits[at], [g / grades for g in range(1, grades)])
        out[at] = 1 + (hits[at, None] > cuts[None, :]).sum(axis=1)
    return out


def _descend(features: tuple[np.ndarray, np.ndarray, np.ndarray], width: int, target: np.ndarray, balance: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by accelerated proximal gradient steps; ``penalty`` is on absolute weights."""
    row, column, value = features
    n, levels = target.shape
    weights, looked = np.zeros(width), np.zeros(width)
    thresholds = t_looked = np.linspace(0.0, 1.0, levels)
    momentum = 1.0
    # The step stays below the inverse of the largest curvature: rows weigh `balance`, each level adds a quarter.
    square = np.bincount(row, value**2, minlength=n)
    step = 4.0 / (levels * float((balance * (square + 1)).sum()) + 1e-9)
    for _ in range(rounds):
        z = np.bincount(row, value * looked[column], minlength=n)
        error = (1 / (1 + np.exp(np.clip(t_looked[None, :] - z[:, None], -500, 500))) - target) * balance[:, None]
        slope = np.bincount(column, value * error.sum(axis=1)[row], minlength=width) + 1e-4 * looked
        moved = looked - step * slope
        moved = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        t_moved = np.sort(t_looked + step * error.sum(axis=0))
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        looked = moved + (momentum - 1) / following * (moved - weights)
        t_looked = t_moved + (momentum - 1) / following * (t_moved - thresholds)
        weights, thresholds, momentum = moved, t_moved, following
    return weights, np.sort(thresholds)


def _only(features: tuple[np.ndarray, np.ndarray, np.ndarray], kept: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of some columns, numbered anew."""
    number = np.full(len(kept), -1)
    number[kept] = np.arange(int(kept.sum()))
    on = kept[features[1]]
    return features[0][on], number[features[1][on]], features[2][on]


def best_cut(chance: np.ndarray, toxic: np.ndarray) -> float:
    """Between which chances the rates of toxic and of clean documents above differ most; of equal places the widest."""
    order = np.argsort(chance, kind="stable")
    sorted_chance, y = chance[order], toxic[order]
    below = np.cumsum((1 - y) / max(1, (1 - y).sum()) - y / max(1, y.sum()))[:-1]
    gap = np.diff(sorted_chance)
    fits = (gap > 0) & (below >= below[gap > 0].max(initial=-1.0) - 1e-12)
    if not fits.any():
        return 0.5
    i = int(np.flatnonzero(fits)[gap[fits].argmax()])
    return float(np.clip((sorted_chance[i] + sorted_chance[i + 1]) / 2, 0.1, 0.9))


def fit_cells(toxic: np.ndarray, row: np.ndarray, column: np.ndarray, n: np.ndarray, words: list[bytes], marks: list[bool], grades: int = GRADES, penalty: float = PENALTY, rounds: int = 400) -> Ordinal:
    """The words that the penalty leaves, and their weights without it, from counts ``n`` of words (columns) in documents (rows)."""
    hits = np.bincount(row, n * np.asarray(marks, bool)[column], minlength=len(toxic)) if len(row) else np.zeros(len(toxic))
    grade = grades_of(hits, toxic, grades)
    levels = [k for k in range(1, grades + 1) if (grade >= k).any()]
    target = np.stack([grade >= k for k in levels], axis=1).astype(float)
    balance = np.where(toxic == 1, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (1 - toxic).sum()))
    value = 1 + np.log(n)
    # Scaled to one size, a rare word that marks a class stands out from frequent words.
    scale = 1 / np.sqrt(np.maximum(np.bincount(column, value**2 * balance[row], minlength=len(words)), 1e-12))
    features = (row, column, value * scale[column])
    weights, _ = _descend(features, len(words), target, balance, penalty, rounds)
    chosen = weights != 0
    features, scale, words = _only(features, chosen), scale[chosen], [w for w, yes in zip(words, chosen, strict=True) if yes]
    weights, thresholds = _descend(features, len(words), target, balance, 0.0, 10 * rounds)
    z = np.bincount(features[0], features[2] * weights[features[1]], minlength=len(toxic)) if len(words) else np.zeros(len(toxic))
    cut = best_cut(1 / (1 + np.exp(np.clip(thresholds[0] - z, -500, 500))), toxic)
    return Ordinal({w: float(x) for w, x in zip(words, weights * scale, strict=True)}, thresholds.tolist(), cut)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Ordinal:
    """Words are counted and screened over the sample in Spark; what is fitted on are the few that pass."""
    rows = sample(docs, labels, most)
    flags = {r["row"]: r["toxic"] for r in rows.select("row", "toxic").collect()}
    sizes = dict(Counter(flags.values()))
    if len(sizes) < 2:
        return Ordinal({}, [])
    words, marks = screened(rows, sizes, PENALTY)
    cells = counted(rows, words).toArrow()
    place = {r: i for i, r in enumerate(sorted(flags))}
    number = {w: i for i, w in enumerate(words)}
    row = np.array([place[r] for r in cells["row"].to_pylist()], np.int64)
    column = np.array([number[w] for w in cells["word"].to_pylist()], np.int64)
    order = np.lexsort((column, row))
    toxic = np.array([flags[r] for r in sorted(flags)], np.int64)
    return fit_cells(toxic, row[order], column[order], np.asarray(cells["n"], np.float64)[order], words, marks)


def scored(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, expected severity, chance of grade 1 or more, and whether it is rejected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reach = [model.reach(t) for t in batch.column(1).to_pylist()]
            first = [r[0] if r else 0.0 for r in reach]
            arrays = [batch.column(0), pa.array([round(sum(r), 9) for r in reach], pa.float64()), pa.array(first, pa.float64()), pa.array([bool(r) and r[0] >= model.cut for r in reach], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "severity", "p_toxic", "rejected"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return read.mapInArrow(run, "doc_id long, severity double, p_toxic double, rejected boolean")


def clean(docs: DataFrame, model: Ordinal) -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            keep = [not ((r := model.reach(t)) and r[0] >= model.cut) for t in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
