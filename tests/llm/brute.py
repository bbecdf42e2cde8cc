"""Plain restatements of the query contracts, for small fixtures."""

import hashlib
import math
import re
import zlib
from collections import Counter

import xxhash

ALNUM, SPACED = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def contamination(docs, items, window=13):
    phrases = {}
    for item, text in items:
        w = ALNUM.findall(lower(text))
        if item is not None and w:
            for i in range(max(1, len(w) - window + 1)):
                phrases.setdefault(tuple(w[i : i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w = ALNUM.findall(lower(text))
        hit, found = set(), set()
        for size in {len(p) for p in phrases}:
            for i in range(len(w) - size + 1):
                owners = phrases.get(tuple(w[i : i + size]))
                if owners:
                    hit.update(range(i, i + size))
                    found |= owners
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(map(str, found)))), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


def licenses(docs, base):
    out = []
    for doc, text in docs:
        w = ALNUM.findall(lower(text))
        places, labels = [], set()
        for phrase, label in base:
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        out.append((doc, len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))))
    return out


def notices(text, templates, coverage=0.8, drift=3):
    """Labels and score of the method: matches of word pairs by diagonal, near diagonals as one, and the share of the template's pairs in the span."""
    w = ALNUM.findall(lower(text))
    labels, best = set(), 0.0
    for phrase, label, exact in templates:
        p = phrase.split()
        if exact:
            if any(w[i : i + len(p)] == p for i in range(len(w))):
                labels.add(label)
                best = 1.0
            continue
        diagonals = {}
        for i in range(len(w) - 1):
            for j in range(len(p) - 1):
                if w[i : i + 2] == p[j : j + 2]:
                    diagonals.setdefault(i - j, []).append(i)
        spans = []
        for d, at in sorted(diagonals.items(), key=lambda x: (min(x[1]), x[0])):
            if spans and abs(d - spans[-1][-1][0]) <= drift and min(at) - max(spans[-1][-1][1]) <= len(p):
                spans[-1].append((d, at))
            else:
                spans.append([(d, at)])
        for span in spans:
            at = [i for _, own in span for i in own]
            there = {tuple(w[i : i + 2]) for i in range(min(at), max(at) + 1)}
            share = sum(tuple(p[j : j + 2]) in there for j in range(len(p) - 1)) / (len(p) - 1)
            if share >= coverage:
                labels.add(label)
                best = max(best, share)
    return ",".join(sorted(labels)), best


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def personal(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 13, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 9, 15)):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if low <= len(digits) <= high and (kind != "card" or luhn(digits)):
                out.append((kind, *m.span()))
    return out


def fingerprint(text):
    w = SPACED.findall(lower(text))
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(docs):
    prints = [fingerprint(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, format(prints[i], "016x"), least.get(root(i))) for i, (doc, _) in enumerate(docs)]


def without_repeats(docs, window=35):
    words = [SPACED.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(docs, words):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((doc, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def top_k(vectors, k=10):
    from math import floor, isfinite

    whole = [(i, [floor(1024 * x) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % 100 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return out


def repaired(rows):
    """Conversations after damage and repair, by trying every way: the least audit of each state after each turn, insertions included. Rows: conv_id, turn, role, text."""
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        space = lambda v: " " if v is None else v
        role, text, tie = space(role), space(text), (space(role), sha(space(text)))
        fault = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        kept += [(turn is not None, turn or 0, tie, turn, role, text)] * (2 if fault == 3 else 1)
    out = []
    for conv, kept in convs.items():
        kept.sort()
        turns = [k[3] for k in kept if k[3] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for *_, role, text in kept:
            last = SPACED.findall(text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1][-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [k[4][:1] for k in kept]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        best = {"": (0, "", ())}

        def with_insertions(best):
            for _ in range(2):
                for state, (cost, audit, text) in list(best.items()):
                    role = "assistant" if state == "u" else "user"
                    way = (cost + 5, audit + "I", (*text, f"{role}:"))
                    best[role[0]] = min(best.get(role[0], way), way)
            return best

        best = with_insertions(best)
        for (*_, role, text), fault in zip(kept, faults, strict=True):
            after = {}

            def reach(state, cost, audit, text, after=after):
                after[state] = min(after.get(state, (cost, audit, text)), (cost, audit, text))

            for state, (cost, audit, done) in best.items():
                reach(state, cost + 2, audit + "D", done)
                if fault in ("blank", "duplicate"):
                    continue
                more = 5 if fault else 0
                if role[:1] and state + role[:1] in ("s", "u", "su", "ua", "au"):
                    reach(role[0], cost + more, audit + "K", (*done, f"{role}:{text}"))
                to = "assistant" if state == "u" else "user"
                reach(to[0], cost + 1 + more, audit + "R", (*done, f"{to}:{text}"))
            best = with_insertions(after)
        cost, audit, done = min(best[s] for s in ("", "a") if s in best)
        count = faults.count
        out.append((conv, gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, sha("\n".join(done))))
    return out


def importance(docs, items, buckets=10_000, percent=5, least=20):
    """doc_id, n_features, weight, score and rank of each document; docs: id and text, items: texts."""

    def features(text):
        w = [x.encode() for x in ALNUM.findall(lower(text))]
        return len(w), [zlib.crc32(b" ".join(w[i : i + k])) % buckets for k in (1, 2, 3) for i in range(len(w) - k + 1)]

    found = [(doc, *features(text)) for doc, text in docs]
    corpus, target = (Counter(b for f in lists for b in f) for lists in ([f[2] for f in found], [features(t)[1] for t in items]))
    s, t = sum(corpus.values()) + buckets, sum(target.values()) + buckets
    gain = [math.floor(1000 * math.log((target[b] + 1) * s / ((corpus[b] + 1) * t))) for b in range(buckets)]
    rows = []
    for doc, n, f in found:
        h = int(sha(f"42:{'' if doc is None else doc}")[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    taking_part = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1]))
    for k, r in enumerate(taking_part[: percent * len(taking_part) // 100], 1):
        r[4] = k
    return [tuple(r[:5]) for r in rows]
