"""Words that differ in bytes that a weak hash overlooks, in both operators that name words by hash."""

import random

from acacia.llm import decontaminate, repeats
from acacia.llm.words import IS_SPACED, Words
from tests.llm import brute

COLUMNS_1 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
COLUMNS_9 = ("doc_id", "n_words", "n_removed", "kept_sha256")


def morse(n, flip=False):
    """The first letters of a sequence on which polynomials modulo a power of two collide with its mirror image."""
    return "".join("ab"[(i.bit_count() + flip) % 2] for i in range(n))


def same(df, columns, want):
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == sorted(want, key=repr)


def test_hashes_tell_words_apart():
    import pyarrow as pa

    rnd = random.Random(5)
    words = {"".join(rnd.choice("ab\0") for _ in range(rnd.randint(1, 12))) for _ in range(3000)}
    words |= {morse(1024), morse(1024, True), "x" * 64, "x" * 65, "x" * 64 + "\0", "é" * 9, "é" * 9 + "\0"}
    found = Words(pa.array([" ".join(words)]), IS_SPACED, False)
    assert len(found) == len(words) == len(set(found.hashes().tolist()))
    assert not set(found.hashes().tolist()) & set(found.hashes(1).tolist())
    joined, start = found.joined(range(0, len(found), 2))
    assert [joined[a:].split(b" ")[0].decode() for a in start[:50]] == [found.data[found.start[i] : found.end[i]].tobytes().decode() for i in range(0, 100, 2)]


def test_words_with_nul_are_other_words(spark):
    plain = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(plain)), (2, " ".join(w + "\0" for w in plain)), (3, "  ".join(plain[:36])), (4, " ".join([*plain[:34], "\0", *plain[34:]]))]
    same(repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")), COLUMNS_9, brute.without_repeats(rows))


def test_words_of_mirrored_letters_are_other_words(spark):
    rows = [(1, morse(1024)), (2, morse(1024, True)), (3, "some " + morse(2048) + " more"), (4, " ".join([morse(1024)] * 36)), (5, " ".join([morse(1024, True)] * 36))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [("q-17", morse(1024, True)), ("b", morse(2048)), ("a", "some")]
    same(decontaminate.report(docs, spark.createDataFrame(items, "item_id string, text string")), COLUMNS_1, brute.contamination(rows, items))
    same(repeats.without_repeats(docs), COLUMNS_9, brute.without_repeats(rows))


def test_matches_are_confirmed_on_words(spark, monkeypatch):
    # A hash of the length alone: all words of one length collide, and only the words themselves can tell.
    items = [("i", "alpha beta gamma"), ("j", "aaaa")]
    rows = [(1, "x alpha beta gamma y"), (2, "x alpha bete gamma y"), (3, "omega beta gamma aaaa bbbb")]
    phrases = decontaminate.Phrases.of(items)
    import numpy as np
    import pyarrow as pa

    from acacia.llm.words import IS_ALNUM

    words = Words(pa.array([t for _, t in rows]), IS_ALNUM, True)
    number = {w: i for i, w in enumerate(phrases.spelled)}
    text = [words.data[a:b].tobytes() for a, b in zip(words.start, words.end)]
    near = np.array([number.get(w, number[b"beta"]) for w in text])
    which = [i for i, s in enumerate(phrases.sizes) if s == 3][0]
    assert phrases.right(words, np.array([1, 6]), np.array([which, which]), near).tolist() == [True, False]


def test_pieces_of_one_bucket_each(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 2000)
    rnd = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, " ".join(f"{rnd.randrange(9)}" for _ in range(80)) + (" " + passage if i % 3 == 0 else "")) for i in range(60)]
    same(repeats.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)), COLUMNS_9, brute.without_repeats(rows))
