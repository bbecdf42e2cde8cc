"""Exact byte-pair encoding of texts with a SentencePiece vocabulary, by backtracking, and its decoding.

SentencePiece merges the two neighbouring symbols whose join is the best-scored piece (the leftmost of
equals) until no join is a piece. Whether two neighbouring pieces can stand in a result depends on the
two alone: merging their joined letters again must give the two back. So an encoding is the one
sequence of pieces whose neighbours are all compatible, and it is found from left to right: an
Aho-Corasick automaton names the longest piece that starts at each place, shorter pieces follow where
the longest isn't compatible with the piece before, and where none is, the place is marked in a bit field
of failed positions and the piece before gives way. No place is tried again once it has failed, so the
work is linear in the text.

A text is cut where no piece can cross: before a space that follows another letter (if the vocabulary
has no piece with a space after another letter) and at ASCII letters that no piece has. The segments in between repeat, and
what they encode to is kept in a table of bounded size in each process; long segments aren't kept. The
vocabulary is read on the driver and goes out as a broadcast of its pieces and scores (some 32,000).

Defined cases: a null text counts as empty, and an empty one has no ids; letters without a piece become their UTF-8
bytes' pieces; strings such as ``</s>`` in a text are ordinary text; texts of any length are encoded
whole; repeated rows, null ids and other columns are kept as they are; an empty table gives no rows. A
model that isn't of the merging kind with byte pieces, a leading space and unchanged letters is refused.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from acacia.llm.words import lists, pieces

#: The letter that stands for a space in pieces.
SPACE = "▁"
#: Segments (and pairs of pieces) of which a task remembers the outcome, and the letters of the longest remembered segment.
REMEMBERED, LONGEST_REMEMBERED = 500_000, 48
#: Bits of a piece's number in a pair.
_PAIR = 32

# Every byte that isn't part of a letter decodes to a replacement character of its own.
codecs.register_error("each_byte", lambda fault: ("\ufffd" * (fault.end - fault.start), fault.end))


def merged(text: str, scores: dict[str, float]) -> list[str]:
    """The symbols of a text when the best-scored join of two neighbours (the leftmost of equals) is made until none is a piece."""
    symbols: list[str | None] = list(text)
    before, after = list(range(-1, len(text) - 1)), [*range(1, len(text)), -1]
    heap: list[tuple[float, int, str]] = []

    def offer(left: int) -> None:
        right = after[left] if left >= 0 else -1
        if right >= 0 and (join := symbols[left] + symbols[right]) in scores:
            heapq.heappush(heap, (-scores[join], left, join))

    for i in range(len(text) - 1):
        offer(i)
    while heap:
        _, left, join = heapq.heappop(heap)
        right = after[left]
        if symbols[left] is None or right < 0 or symbols[left] + symbols[right] != join:
            continue  # one of the two has been merged with another since
        symbols[left], symbols[right] = join, None
        after[left] = after[right]
        if after[left] >= 0:
            before[after[left]] = left
        offer(before[left])
        offer(left)
    return [s for s in symbols if s is not None]


class Vocabulary:
    """Pieces that text can be merged to, with their ids and scores, and the ids of the 256 byte pieces. Goes to the tasks as it is."""

    def __init__(self, pieces: list[str], ids: list[int], scores: list[float], byte_ids: list[int]):
        self.ids = dict(zip(pieces, ids, strict=True))
        self.scores = dict(zip(pieces, scores, strict=True))
        self.byte_ids = byte_ids
        #: Pieces that merging their own letters gives; the others never stand in an encoding.
        self.reached = [p for p in pieces if merged(p, self.scores) == [p]]
        self.name = hashlib.sha256(repr((pieces, ids, scores, byte_ids)).encode()).hexdigest()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Vocabulary) and self.name == other.name

    def __hash__(self) -> int:
        return hash(self.name)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """The vocabulary of a model file, read on the driver."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(model.is_byte(i) for i in byte_ids):
            raise ValueError("the model has no byte pieces")
        if any(model.is_unused(i) for i in range(size)):
            raise ValueError("the model has unused pieces")
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        out = cls([model.id_to_piece(i) for i in plain], plain, [model.get_score(i) for i in plain], byte_ids)
        encoder = Encoder(out)
        for probe in ("the  cat\n sat, ", " ﬁ ¼ é", "a▁b"):  # leading space, spaces and letters kept, merges by score
            if encoder.encode(probe).tolist() != model.encode(probe):
                raise ValueError("only merging models that keep letters and spaces and add a leading space are supported")
        return out


class _Remembered(dict):
    """What a function gave for the arguments met of late: two generations of up to ``REMEMBERED`` each."""

    def __init__(self, of, size=lambda key: 0):
        super().__init__()
        self.of, self.size, self.older = of, size, {}

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.of(key)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        if self.size(key) <= LONGEST_REMEMBERED:
            self[key] = out
        return out


def _listed(letters: set[str]) -> str:
    """Letters as the inside of a pattern's class."""
    return "".join(map(re.escape, sorted(letters)))


class Encoder:
    """Encodes and decodes with a vocabulary inside a task."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        self.automaton = ahocorasick.Automaton()
        self.pieces, number = v.reached, {p: k for k, p in enumerate(v.reached)}
        self.size = [len(p) for p in v.reached]
        for k, p in enumerate(v.reached):
            self.automaton.add_word(p, (self.size[k], k))
        if v.reached:
            self.automaton.make_automaton()
        #: The next shorter piece that a piece begins with, or -1.
        self.shorter = [next((number[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in number), -1) for p in v.reached]
        self.number_ids = [v.ids[p] for p in v.reached]
        self.letters = set().union(*v.scores) if v.scores else set()
        self.segments = re.compile(self._borders(), re.DOTALL).findall
        self.byte_of = {i: bytes([b]) for b, i in enumerate(v.byte_ids)}
        #: The text of each id, for texts whose only byte pieces are ASCII.
        self.text_of = {i: p.replace(SPACE, " ") for p, i in v.ids.items()} | {i: chr(b) for b, i in enumerate(v.byte_ids) if b < 0x80}
        self.compatible = _Remembered(self._compatible)
        self.encoded = _Remembered(self._segment, len)

    def _borders(self) -> str:
        """A pattern of the segments that a text falls into: nothing in the vocabulary reaches over a border between two of them."""
        foreign = {chr(c) for c in range(128)} - self.letters - {" "}
        inside = any(SPACE in p.lstrip(SPACE) for p in self.vocabulary.scores)  # then only letters without a piece are borders
        space = "" if inside else SPACE
        return f"{space + '*' if space else ''}[^{space}{_listed(foreign)}]+|" + (f"{space}+|" if space else "") + "."

    def _compatible(self, pair: int) -> bool:
        """Whether merging the letters of two pieces (the first one's number in the upper bits) gives the two again."""
        left, right = self.pieces[pair >> _PAIR], self.pieces[pair & (1 << _PAIR) - 1]
        return left + right not in self.vocabulary.scores and merged(left + right, self.vocabulary.scores) == [left, right]

    def backtracked(self, text: str) -> list[int] | None:
        """The numbers of a text's pieces, or None where it has none."""
        size, shorter, compatible = self.size, self.shorter, self.compatible
        longest = [-1] * (len(text) + 1)
        for end, (n, k) in self.automaton.iter(text):
            longest[end + 1 - n] = k  # matches come by their end, so the last one from a place is its longest
        failed = bytearray((len(text) >> 3) + 1)
        out: list[int] = []
        at, k = 0, longest[0]
        while at < len(text):
            before = out[-1] << _PAIR if out else -1
            while k >= 0:
                end = at + size[k]
                if (before < 0 or compatible[before | k]) and not failed[end >> 3] >> (end & 7) & 1:
                    break
                k = shorter[k]
            if k >= 0:
                out.append(k)
                at = end
                k = longest[at]
            elif out:
                failed[at >> 3] |= 1 << (at & 7)
                k = out.pop()
                at -= size[k]
                k = shorter[k]
            else:
                return None
        return out

    def _segment(self, segment: str) -> bytes:
        """The ids of a segment as bytes of 32-bit integers."""
        ids: list[int] = []
        of = self.vocabulary.ids
        for foreign, run in itertools.groupby(segment, lambda c: c not in self.letters) if not self.letters.issuperset(segment) else [(False, segment)]:
            run = "".join(run)
            if foreign:
                ids += [self.vocabulary.byte_ids[b] for b in run.encode("utf-8")]
            else:
                found = self.backtracked(run)
                ids += map(of.__getitem__, merged(run, self.vocabulary.scores)) if found is None else map(self.number_ids.__getitem__, found)
        return array("i", ids).tobytes()

    def encode(self, text: str | None) -> array:
        """The ids of a text."""
        if not text:
            return array("i")
        return array("i", b"".join(map(self.encoded.__getitem__, self.segments(SPACE + text.replace(" ", SPACE)))))

    def decode(self, ids: array) -> str:
        """The text of some ids: pieces joined, runs of byte pieces read as UTF-8, and one space, which encoding adds, taken away at the start."""
        try:
            text = "".join(map(self.text_of.__getitem__, ids))
        except KeyError:
            parts = itertools.groupby(ids, self.byte_of.__contains__)
            text = "".join(b"".join(map(self.byte_of.__getitem__, run)).decode("utf-8", "each_byte") if raw else "".join(map(self.text_of.__getitem__, run)) for raw, run in parts)
        return text[1:] if len(ids) and ids[0] not in self.byte_of and text.startswith(" ") else text


@lru_cache(maxsize=1)
def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """The encoder of this process, which keeps what it remembers from one task to the next."""
    return Encoder(vocabulary)


def encoded(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """The rows of a table with ``ids`` (array of int) and ``decoded`` (text) of a text column.

    ``ids`` and ``decoded`` replace columns of those names, whatever their case.
    """
    kept = [f for f in docs.schema.fields if f.name.lower() not in ("ids", "decoded")]
    docs = docs.select([docs[f"`{f.name}`"] for f in kept])
    at = next(i for i, f in enumerate(kept) if f.name == text)
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file's pieces

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for batch in batches:
            for part in pieces(batch, at):
                ids = list(map(encoder.encode, part.column(at).to_pylist()))
                flat = np.frombuffer(b"".join(ids), np.int32)
                texts = pa.array(map(encoder.decode, ids), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, lists(flat, np.array([len(i) for i in ids], np.int64), pa.int32()), texts], [*part.schema.names, "ids", "decoded"])

    return docs.mapInArrow(run, schema)
