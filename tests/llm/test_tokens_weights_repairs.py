"""Encoding against the library, importance resampling and repaired conversations against plain restatements."""

import random
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from public_tokenizers import path

import __spark_entry__ as entry
from acacia.llm import repair, resample, tokens
from acacia.llm.words import IS_ALNUM, Words
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.test_against_brute_force import ODD, none, odd, rows_of, same  # noqa: F401

MODEL = path("piece_bpe_32k.model")


# 11


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.Vocabulary.read(MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def encodings(library, docs):
    out = []
    for doc, text in docs:
        ids = library.encode(text or "")
        out.append((doc, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids))))
    return out


COLUMNS_11 = ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def test_encoding_given(spark, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    same(rows_of(entry.queries()["op11_sentencepiece"](spark, SMALL), *COLUMNS_11), encodings(library, docs))


def test_encoding_odd(odd, none, vocabulary, library):  # noqa: F811
    out = tokens.encoded(odd, vocabulary)
    assert out.columns == [*odd.columns, "ids", "decoded"]
    got = [(r.doc_id, list(r.ids), r.decoded) for r in out.collect()]
    want = [(doc, ids, library.decode(ids)) for doc, text in ODD for ids in [library.encode(text or "")]]
    same(sorted(got, key=repr), want)
    assert tokens.encoded(none, vocabulary).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("  \n\tabethinsr.,▁é日𠀀\x00<s>/0xA"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_encoding_equals_the_library(text):
    encoder, library = ENCODER, LIBRARY
    ids = encoder.encode(text)
    assert ids.tolist() == library.encode(text)
    assert encoder.decode(ids) == library.decode(ids.tolist())


LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ENCODER = tokens.Encoder(tokens.Vocabulary.read(MODEL))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(3, 31_999), st.integers(3, 258)), max_size=12))
def test_decoding_any_ids(ids):
    assert ENCODER.decode(array("i", ids)) == LIBRARY.decode(ids)


def test_backtracking_on_made_vocabularies():
    """Vocabularies in which the longest piece is often wrong, pieces with spaces inside and pieces that merging never reaches."""
    rng = random.Random(5)
    failures = 0
    for _ in range(60):
        scores = {c: -1000.0 for c in "abc▁"}
        known = list(scores)
        for i in range(rng.randrange(3, 25)):
            scores.setdefault(rng.choice(known) + rng.choice(known), float(-rng.randrange(12) if rng.random() < 0.3 else -i))
            known = list(scores)
        vocabulary = tokens.Vocabulary(known, list(range(len(known))), list(scores.values()), list(range(len(known), len(known) + 256)))
        encoder = tokens.Encoder(vocabulary)
        for _ in range(60):
            text = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 40)))
            whole = tokens.merged("▁" + text.replace(" ", "▁"), scores)
            assert [known[i] for i in encoder.encode(text)] == whole
            greedy, at = [], 0
            letters = "▁" + text.replace(" ", "▁")
            while at < len(letters):
                greedy.append(max((p for p in known if letters.startswith(p, at)), key=len))
                at += len(greedy[-1])
            failures += greedy != whole
    assert failures > 100


def test_long_runs():
    for text in ("a" * 30_000, " " * 30_001, "the " * 9_000, "\x00" * 3_000, "日本" * 5_000):
        assert ENCODER.encode(text).tolist() == LIBRARY.encode(text)


# 12


def test_importance_given(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("text").collect()]
    got = rows_of(entry.queries()["op12_importance"](spark, SMALL), "doc_id", "n_features", "weight", "score", "rank")
    same(got, brute.importance(docs, items))


def test_importance_odd(spark, odd, none):  # noqa: F811
    columns = ("doc_id", "n_features", "weight", "score", "rank")
    rows = ODD + [(100 + i // 2, f"{t} alpha beta {i // 2}") for i in range(60) for t in [brute_words(i // 2)]]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, `Rank` string, Part string").repartition(3)
    items = ["alpha beta gamma", None, "", ODD[5][1]]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")
    same(rows_of(resample.drawn(docs, target), *columns), brute.importance(rows, items))
    assert resample.drawn(none, target).collect() == []
    same(rows_of(resample.drawn(docs, target.limit(0)), *columns), brute.importance(rows, []))
    kept = resample.drawn(docs, target, keep=("doc_id", "Rank", "Part"), percent=100)
    assert kept.columns == ["doc_id", "Part", "n_words", "n_features", "weight", "score", "rank"]
    assert {(r["Part"], r["rank"] is None) for r in kept.where("n_words >= 20").collect()} == {("y", False)}


def brute_words(i):
    return " ".join(f"w{(i * k) % 11}" for k in range(1, 30))


def test_ranks_without_one_task(spark):
    """Most documents are copies of one row: ranks stay whole and in order."""
    text = brute_words(3)
    docs = spark.createDataFrame([(7, text)] * 500 + [(i, text) for i in range(500)], "doc_id long, text string")
    target = spark.createDataFrame([("alpha",)], "text string")
    rows = resample.drawn(docs, target, percent=50).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 501))
    assert [(-r.score, r.doc_id) for r in rows] == sorted((-r.score, r.doc_id) for r in rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcXé 1-"), max_size=40), max_size=4), st.integers(0, 6), st.integers(0, 9))
def test_head_and_tail_agree(texts, n_words, n_pairs):
    """Whatever the head holds, buckets are those of the features' bytes."""
    words = [brute.ALNUM.findall(brute.lower(t)) for t in texts]
    runs = [w.encode() for ws in words for w in ws]
    pairs = [(a.encode(), b.encode()) for ws in words for a, b in zip(ws, ws[1:], strict=False)]
    head = resample.Head.of(list(dict.fromkeys(runs))[:n_words], list(dict.fromkeys(pairs))[:n_pairs])
    got, owner = resample.buckets_of(Words(pa.array(texts, pa.string()), IS_ALNUM, lower=True), head)
    want = sorted((i, zlib.crc32(" ".join(ws[k : k + n]).encode()) % 10_000) for i, ws in enumerate(words) for n in (1, 2, 3) for k in range(len(ws) - n + 1))
    assert sorted(zip(owner.tolist(), got.tolist(), strict=True)) == want


def test_states_carried_over_long_words():
    parts = [b"a", b"b" * 63, b"c" * 64, b"d" * 65, b"e" * 5_000, b"f" * 70_001]
    crc = np.array([zlib.crc32(b"start")] * len(parts), np.uint32)
    got = resample.advanced(crc, np.array([len(p) for p in parts])) ^ np.array([zlib.crc32(p) for p in parts], np.uint32)
    assert got.tolist() == [zlib.crc32(b"start" + p) for p in parts]
    texts = [" ".join(("x" * n, "y" * m, "z")) for n in (1, 63, 64, 65, 900) for m in (2, 63, 64, 5_000)]
    got, _ = resample.buckets_of(Words(pa.array(texts), IS_ALNUM, lower=True), resample.Head.of([], []))
    want = [zlib.crc32(" ".join(t.split()[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for t in texts for k in range(4 - n)]
    assert sorted(got.tolist()) == sorted(want)


# 13


COLUMNS_13 = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_repair_given(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(rows_of(entry.queries()["op13_conversations"](spark, SMALL), *COLUMNS_13), brute.repaired(rows))


def test_repair_odd(spark):
    """Null ids and turns, odd roles, ties, one conversation with most rows and one of equal rows, extra columns."""
    rng = random.Random(3)
    turns = [None, *range(12)]
    roles, texts = [None, "user", "assistant", "system", "tool", "", "Äh", "ua"], [None, "", " \t", "Hi.", "Hi", "No!", "x ? ", "ß…"]
    rows = [(rng.choice([None, *range(40)]), rng.choice(turns), rng.choice(roles), rng.choice(texts)) for _ in range(300)]
    rows += [(1000, k, rng.choice(roles[1:4]), rng.choice(["a.", "b", "c!", f"e.{k}", f"f{k}."])) for k in range(2_000)]
    rows += [(1001, 5, "user", "same.")] * 700
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, AUDIT string, at int").repartition(3)
    same(rows_of(repair.repaired(df), *COLUMNS_13), brute.repaired(rows))
    assert repair.repaired(df.limit(0)).collect() == []


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "user", "Q?"), (1, 2, "user", "A."), (2, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    report, parts = repair.repair(df.selectExpr("*", "struct(role, text) as tie"))
    found = {}
    for r in parts.orderBy("conv_id", "at").collect():
        found.setdefault(r.conv_id, []).extend(map(tuple, r.turns))
    assert found == {1: [("system", "S."), ("user", "Q?"), ("assistant", "A.")], 2: []}
    assert {(r.conv_id, r.cost, r.audit) for r in report.collect()} == {(1, 1, "KKR"), (2, 2, "D")}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([a + b for a in "sua-" for b in ".xt"]), max_size=14), st.data())
def test_both_ends_meet_at_the_least(turns, data):
    """Against all ways by dynamic programming, whole and in parts."""
    best = {0: (0, "")}

    def inserted(best):
        for _ in range(2):
            for q, (cost, audit) in list(best.items()):
                to = 3 if q == 2 else 2
                best[to] = min(best.get(to, (10**9, "")), (cost + 5, audit + "I"))
        return best

    inserted(best)
    for turn in turns:
        after = {}
        for q, to, cost, letter in repair._edges(turn):
            if q in best:
                way = (best[q][0] + cost, best[q][1] + letter)
                after[to] = min(after.get(to, way), way)
        best = inserted(after)
    want = min(best[q] for q in (0, 3) if q in best)
    assert repair.audit_of("".join(turns)) == want
    cut = sorted(data.draw(st.lists(st.integers(0, len(turns)), max_size=3)))
    bounds = [0, *cut, len(turns)]
    steps = [tuple(repair._between("".join(turns[a:b]))) for a, b in zip(bounds, bounds[1:], strict=False)]
    assert repair.cheapest(steps, (), 0, (0, 3))[:2] == want
