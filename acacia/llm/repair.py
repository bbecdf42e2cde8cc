"""Cheapest repair of conversations so that their roles alternate, as a shortest path over an edit lattice.

A conversation's turns are kept (cost 0), given another role (1) or deleted (2, and the only choice for blank and
repeated ones), turns without text are inserted (5), and every truncated turn that stays costs 5 more. The
initials of the roles that are left must read ``(s?(ua)+)?``: a system turn or none, then user and assistant in
turn, or nothing at all. Nodes of the lattice are a place between turns and what came last (nothing, s, u, a).

Dijkstra's search runs from both ends: two heaps meet, all crossings of equal cost are finished, and of
these the audit (the edits' initials in order) that is least as ASCII text is taken. An audit alone decides its cost, so
no cheapest audit of a node is the beginning of another one, and the least audit is made of least parts.

Spark sorts the turns once by ranges of conversation and turn and numbers them; blocks of ``BLOCK`` consecutive turns are
the unit of work, however many turns a conversation has. A conversation inside a block is repaired there. One
that a border cuts gets, for each part, the cheapest audits between all pairs of states; the parts are then
the steps of a smaller lattice, searched in the same way, and each part is repaired between its two states.
No task sees more than a block of texts; the final digest of a cut conversation reads its parts as a stream.
An audit has a letter for each edit, so a conversation's must fit into one value.

Defined cases: a null id is a conversation of its own, null turns come first; turns with equal numbers are ordered by role
and a digest of the text, equal ones among them being interchangeable; a null role or text counts as one space; a role
that is empty or has another initial than s, u and a can't stay as it is; a conversation without turns has no cost, an
empty audit and no parts; gaps beyond 64 bits count as the largest number; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from acacia.llm.work import partitions, written

#: Turns of a block, a power of two.
BLOCK = 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

_NONE, _SYSTEM, _USER, _ASSISTANT = range(4)
_STATES = range(4)
_LEGAL = ("su", "ua", "au")
#: (from, to, cost, letter)
Edge = tuple[int, int, int, str]
_INSERTS: tuple[Edge, ...] = tuple((q, _ASSISTANT if q == _USER else _USER, INSERT, "I") for q in _STATES)


def _after(state: int, initial: str) -> int | None:
    """The state after a turn that stays with its role, if it may."""
    if initial == "s":
        return _SYSTEM if state == _NONE else None
    if initial == "u":
        return None if state == _USER else _USER
    return _ASSISTANT if initial == "a" and state == _USER else None


@lru_cache(maxsize=64)
def _edges(turn: str) -> tuple[Edge, ...]:
    """The edits of a turn, given by two letters: its initial (or ``-``), and ``x`` if it must go, ``t`` if it is truncated, or ``.``."""
    out: list[Edge] = [(q, q, DELETE, "D") for q in _STATES]
    if turn[1] != "x":
        more = TRUNCATED if turn[1] == "t" else 0
        out += [(q, to, KEEP + more, "K") for q in _STATES if (to := _after(q, turn[0])) is not None]
        out += [(q, _ASSISTANT if q == _USER else _USER, REROLE + more, "R") for q in _STATES]
    return tuple(out)


def cheapest(steps: list[tuple[Edge, ...]], within: tuple[Edge, ...], entry: int, exits: tuple[int, ...]) -> tuple[int, str, list[int]] | None:
    """The cheapest way from a state before the first step to one of the exits after the last, of equals the one with the least audit: cost, audit and the states passed. ``within``: edges that take no step."""
    n = len(steps)
    start, ends = (0, entry), [(n, q) for q in exits]
    labels = ({start: (0, "")}, {v: (0, "") for v in ends})
    came: tuple[dict, dict] = ({}, {})
    # Edges without cost always take a step, so among nodes of equal cost those with fewer steps so far are final first.
    heaps = ([(0, 0, entry)], [(0, 0, q) for q in exits])
    settled: tuple[set, set] = (set(), set())
    best = 0 if start in ends else None
    while heaps[0] and heaps[1] and (best is None or heaps[0][0][0] + heaps[1][0][0] <= best):
        side = 0 if heaps[0][0] <= heaps[1][0] else 1
        cost, taken, state = heapq.heappop(heaps[side])
        row = n - taken if side else taken
        if (row, state) in settled[side]:
            continue
        settled[side].add((row, state))
        audit = labels[side][row, state][1]
        step = steps[row - side] if 0 <= row - side < n else ()
        for edges, moved in ((within, 0), (step, 1)):
            for edge in edges:
                if edge[side] != state:
                    continue
                node = (row - moved if side else row + moved, edge[1 - side])
                label = (cost + edge[2], edge[3] + audit if side else audit + edge[3])
                known, other = labels[side].get(node), labels[1 - side].get(node)
                if known is None or label < known:
                    labels[side][node], came[side][node] = label, (row, state)
                    if known is None or label[0] < known[0]:
                        heapq.heappush(heaps[side], (label[0], taken + moved, node[1]))
                    if other is not None and (best is None or label[0] + other[0] < best):
                        best = label[0] + other[0]
    if best is None:
        return None
    few, many = sorted(labels, key=len)
    audit, at = min((labels[0][v][1] + labels[1][v][1], v) for v in few if v in many and labels[0][v][0] + labels[1][v][0] == best)
    path = [at]
    while path[0] in came[0]:
        path.insert(0, came[0][path[0]])
    while path[-1] in came[1]:
        path.append(came[1][path[-1]])
    return best, audit, [q for _, q in path]


def _steps(turns: str) -> list[tuple[Edge, ...]]:
    return [_edges(turns[i : i + 2]) for i in range(0, len(turns), 2)]


@lru_cache(maxsize=1 << 14)
def audit_of(turns: str) -> tuple[int, str]:
    """Cost and audit of a whole conversation, two letters a turn."""
    return cheapest(_steps(turns), _INSERTS, _NONE, (_NONE, _ASSISTANT))[:2]


@lru_cache(maxsize=1 << 12)
def _between(turns: str) -> list[tuple[int, int, int, str]]:
    """The edges that some turns make from any state to any other."""
    steps = _steps(turns)
    found = [(q, to, cheapest(steps, _INSERTS, q, (to,))) for q in _STATES for to in _STATES]
    return [(q, to, *way[:2]) for q, to, way in found if way is not None]


def edited(audit: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The turns that an audit leaves, starting in a state."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        if edit == "K":
            turn = roles[i], texts[i]
        else:
            turn = "assistant" if state == _USER else "user", "" if edit == "I" else texts[i]
        i += edit != "I"
        state = {"s": _SYSTEM, "u": _USER, "a": _ASSISTANT}[turn[0][:1]]
        out.append(turn)
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """The query's fixed damage: by the checksum of ``conv_id:turn`` some turns are dropped, emptied, stripped of their stops, repeated or given to the user.

    ``tie`` orders turns with equal numbers.
    """
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    rows = conversations.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.crc32(F.concat(conv, F.lit(":"), turn)).alias("sum"), F.struct(role.alias("role"), F.sha2(text, 256).alias("text")).alias("tie")
    )
    fault = F.col("sum") % 20
    return rows.where(fault != 0).select(
        "conv_id", "turn", F.when(fault == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, F.lit("")).when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), "tie",
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What was found and done by conversation, and the repaired turns.

    ``turns``: conv_id, turn, role, text (no nulls in the last two) and ``tie``, which orders turns with equal numbers.
    First result: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Second: conv_id, at (the order of a
    conversation's parts), whole (whether it has only this part) and turns, an array of role and text.
    """
    spark = turns.sparkSession
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("tie")]
    # Equal turns are dealt out by a number of their own, so that no part holds all copies of one.
    in_order = (
        turns.withColumn("spread", F.monotonically_increasing_id()).repartitionByRange(partitions(spark), *keys, F.col("spread")).sortWithinPartitions(*keys, F.col("spread"))
        .withColumn("at", F.monotonically_increasing_id())
    )
    left = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    rows = written(in_order.select("conv_id", "turn", "role", "text", "at", (left == "").alias("blank"), (~F.substring(left, -1, 1).isin(".", "!", "?")).alias("cut")), "turns")

    named = rows.where(~F.col("blank")).select("at", "conv_id", "role", F.sha2("text", 256).alias("digest"))
    firsts = named.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at")
    repeats = written(named.select("at").join(firsts, "at", "left_anti"), "repeated_turns")

    runs = written(_repair_blocks(rows, repeats), "runs")
    cut = runs.where(~F.col("whole"))
    ways = cut.select("conv_id", "at", "illegal", "first", "last", "ways")
    joins = written(ways.groupBy("conv_id").applyInArrow(_joined, f"conv_id {_kind(rows)}, at long, entry int, own string, illegal long, cost long, audit string"), "joins")

    turn = F.col("turn").cast("decimal(38,0)")
    numbers = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).groupBy("conv_id").agg((F.max(turn) - F.min(turn) + 1 - F.count("turn")).alias("gaps"))
    faults = rows.join(repeats.withColumn("again", F.lit(True)), "at", "left").groupBy("conv_id").agg(
        F.count_if("blank").alias("blank"), F.count_if("again").alias("duplicate"), F.count_if(F.col("cut") & ~F.col("blank") & F.col("again").isNull()).alias("truncated")
    )
    parts = [numbers, faults, runs.where("whole").select("conv_id", "illegal", "cost", "audit"), joins.select("conv_id", "illegal", "cost", "audit")]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    most = F.lit((1 << 63) - 1)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    report = whole.groupBy("conv_id").agg(F.least(F.coalesce(F.max("gaps"), F.lit(0)), most).cast("long").alias("gaps"), *sums, F.max("audit").alias("audit"))

    done = cut.select("conv_id", "at", "whole", "roles", "texts").join(joins.select("at", "entry", "own"), "at")
    repaired = runs.where("whole").select("conv_id", "at", "whole", "turns").unionByName(done.select("conv_id", "at", "whole", "roles", "texts", "entry", "own").mapInArrow(_edit_parts, f"conv_id {_kind(rows)}, at long, whole boolean, {_TURNS}"))
    return report, repaired


def digests(parts: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of each conversation's ``role:text`` lines, from its parts; those of a conversation in several parts are read as a stream in their order."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    bodies = parts.select("conv_id", "at", "whole", F.when(F.size("turns") > 0, lines).alias("body"))
    kind = _kind(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest, some = None, None, False
        for batch in batches:
            ids, out = [], []
            for c, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if digest is None or c != conv:
                    if digest is not None:
                        ids.append(conv)
                        out.append(digest.hexdigest())
                    conv, digest, some = c, hashlib.sha256(), False
                if body is not None:
                    digest.update((("\n" if some else "") + body).encode())
                    some = True
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(out, pa.string())], ["conv_id", "repaired_sha256"])
            last = batch.schema.field(0).type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([conv], last), pa.array([digest.hexdigest()], pa.string())], ["conv_id", "repaired_sha256"])

    whole = bodies.where("whole").select("conv_id", F.sha2(F.coalesce("body", F.lit("")), 256).alias("repaired_sha256"))
    cut = bodies.where(~F.col("whole")).select("conv_id", "body", "at").repartition(partitions(parts.sparkSession), "conv_id").sortWithinPartitions("conv_id", "at")
    return whole.unionByName(cut.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string"))


def repaired(conversations: DataFrame) -> DataFrame:
    """Report and digest of every conversation after the query's damage and repair."""
    report, parts = repair(damaged(conversations))
    everyone = conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).drop("n")
    whole = everyone.unionByName(report, allowMissingColumns=True).unionByName(digests(parts), allowMissingColumns=True)
    sums = [F.coalesce(F.max(c), F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return whole.groupBy("conv_id").agg(*sums, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(empty)).alias("repaired_sha256"))


_TURNS = "turns array<struct<role: string, text: string>>"
_RUN = (
    "at long, whole boolean, illegal long, first string, last string, cost long, audit string, "
    f"ways array<struct<q: int, to: int, cost: long, audit: string>>, roles array<string>, texts array<string>, {_TURNS}"
)


def _kind(df: DataFrame) -> str:
    return dict(df.dtypes)["conv_id"]


def _listed(turns: list[tuple[str, str]]) -> list[dict[str, str]]:
    return [{"role": r, "text": t} for r, t in turns]


def _repair_blocks(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """A row for each conversation's part in each block. ``rows``: numbered turns (``at``); ``repeats``: the numbers of repeated ones."""
    schema = rows.sparkSession.createDataFrame([], f"conv_id {_kind(rows)}, {_RUN}").schema
    arrow = to_arrow_schema(schema)

    def block(turns: pa.Table, again: pa.Table) -> pa.Table:
        turns = turns.sort_by("at")
        repeated = set(again["at"].to_pylist())
        conv, at, roles, texts, blank, cut = (turns[c].to_pylist() for c in ("conv_id", "at", "role", "text", "blank", "cut"))
        borders = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
        out = []
        for a, b in zip(borders, borders[1:], strict=False):
            first = [r[:1] for r in roles[a:b]]
            code = "".join((f if f in ("s", "u", "a") else "-") + ("x" if blank[i] or at[i] in repeated else "t" if cut[i] else ".") for i, f in enumerate(first, a))
            illegal = sum(x + y not in _LEGAL for x, y in zip(first, first[1:], strict=False))
            whole = a > 0 and b < len(conv)  # the first and the last part of a block may go on in another
            row = dict.fromkeys(arrow.names) | {"conv_id": conv[a], "at": at[a], "whole": whole, "illegal": illegal, "first": first[0], "last": first[-1]}
            if whole:
                cost, audit = audit_of(code)
                row |= {"cost": cost, "audit": audit, "turns": _listed(edited(audit, _NONE, roles[a:b], texts[a:b]))}
            else:
                row |= {"ways": [dict(zip(("q", "to", "cost", "audit"), way, strict=True)) for way in _between(code)], "roles": roles[a:b], "texts": texts[a:b]}
            out.append(row)
        return pa.Table.from_pylist(out, schema=arrow)

    of = F.shiftright("at", BLOCK.bit_length() - 1).alias("block")
    return rows.drop("turn").groupBy(of).cogroup(repeats.groupBy(of)).applyInArrow(block, schema)


def _joined(ways: pa.Table) -> pa.Table:
    """The parts of one conversation, each with its audit and entry state; cost, audit and illegal neighbours across parts stand with the first."""
    ways = ways.sort_by("at")
    steps = [tuple((w["q"], w["to"], w["cost"], w["audit"]) for w in part) for part in ways["ways"].to_pylist()]
    cost, audit, states = cheapest(steps, (), _NONE, (_NONE, _ASSISTANT))
    own = [next(w[3] for w in step if w[:2] == pair) for step, pair in zip(steps, zip(states, states[1:], strict=False), strict=True)]
    first, last, illegal = (ways[c].to_pylist() for c in ("first", "last", "illegal"))
    illegal[0] += sum(x + y not in _LEGAL for x, y in zip(last, first[1:], strict=False))
    others = [None] * (len(steps) - 1)
    return pa.table({
        "conv_id": ways["conv_id"], "at": ways["at"], "entry": pa.array(states[:-1], pa.int32()), "own": pa.array(own, pa.string()),
        "illegal": pa.array(illegal, pa.int64()), "cost": pa.array([cost, *others], pa.int64()), "audit": pa.array([audit, *others], pa.string()),
    })


def _edit_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired turns of parts whose audits are known."""
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        conv, at, whole, *rest = batch.columns
        roles, texts, entry, own = (c.to_pylist() for c in rest)
        turns = [_listed(edited(o, e, r, t)) for o, e, r, t in zip(own, entry, roles, texts, strict=True)]
        yield pa.RecordBatch.from_arrays([conv, at, whole, pa.array(turns, kind)], ["conv_id", "at", "whole", "turns"])
