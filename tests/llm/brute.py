"""Plain Python answers to the operators' queries, one text at a time."""

from __future__ import annotations

import collections
import hashlib
import math
import re
import zlib

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def near(rows, shingle=4, percent=85):
    sets = []
    for _, t in rows:
        w = PLAIN.findall(lower(t))
        k = min(shingle, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    holders = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for t in s for j in holders[t]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
        for t in s:
            holders[t].append(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(sets[i]), least.get(top(i))) for i, (d, _) in enumerate(rows)]


def substrings(rows, window=35):
    texts = [PLAIN.findall(t or "") for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, texts):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), len(w) - len(kept), sha(" ".join(kept))))
    return out


def suffixes(rows, length=50):
    last = 1 << 62
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, last + 1), last if d is None else d)
    out = []
    for d, t in rows:
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (last if d is None else d):
                gone[i : i + length] = b"\x01" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), len(b) - len(kept), len(re.findall(b"\x01+", bytes(gone))), sha(kept)))
    return out


def quality(text):
    t = text or ""
    w = PLAIN.findall(t)
    lines = [x for x in t.split("\n") if PLAIN.search(x)]
    seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = [0] * len(w)
    for i in range(len(w) - 2):
        if seen[tuple(w[i : i + 3])] > 1:
            marked[i : i + 3] = [1] * 3
    r = sum(marked)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), r, len(w) < 50 or 100 * r > 50 * len(w)


def held_out(d):
    return zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2


def scores(rows, order):
    """Word unigram figures and the byte model's score, by dictionaries."""
    tokens = [PLAIN.findall(lower(t)) + [None] for _, t in rows]
    count = collections.Counter(x for (d, _), w in zip(rows, tokens) if not held_out(d) for x in w)
    total, kinds = sum(count.values()), len(count)
    stream = [b"\n" * order + " ".join(w[:-1]).encode() + b"\n" for w in tokens]
    table = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    size = 0
    for (d, _), s in zip(rows, stream):
        if not held_out(d):
            size += len(s) - order
            for i in range(order, len(s)):
                for k in range(order + 1):
                    table[k][s[i - k : i]][s[i]] += 1

    def model(s):
        out = 0.0
        for i in range(order, len(s)):
            gone = set()
            for k in range(order, -1, -1):
                kept = table[k].get(s[i - k : i])
                if not kept:
                    continue
                full = max(sum(kept.values()), size if k == 0 else table[k - 1].get(s[i - k : i - 1], {}).get(s[i - 1], 0))
                free = {b: n for b, n in kept.items() if b not in gone}
                here, rest = full - sum(n for b, n in kept.items() if b in gone), full - sum(kept.values())
                if s[i] in free:
                    out += math.log10(free[s[i]] / (here + len(free)))
                    break
                if len(free) + rest:
                    out += math.log10((len(free) + rest) / (here + len(free)))
                gone |= set(kept)
            else:
                out -= math.log10(max(1, 256 - len(gone)))
        return out

    return [
        (d, held_out(d), len(w), sum(count[x] > 0 for x in w), total, sum(math.log10((count[x] + 1) / (total + kinds + 1)) for x in w), model(s))
        for (d, _), w, s in zip(rows, tokens, stream)]


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def personal(text):
    found, n = [], [0] * 4
    for j, (kind, pattern) in enumerate(PERSONAL):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                n[j] += 1
                found.append((m.start(), j, kind, m.end()))
    lines = [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]
    return (*n, sha(",".join(lines))), lines


def licenses(text, phrases):
    w = TERM.findall(lower(text))
    places, labels = [], set()
    for phrase, label in phrases:
        q = phrase.split()
        for k in range(len(w) - len(q) + 1):
            if w[k : k + len(q)] == q:
                places.append(k)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def contamination(rows, items, window=10):
    owners = collections.defaultdict(set)
    for i, t in items:
        w = TERM.findall(lower(t))
        for k in range(max(1, len(w) - window + 1)) if w else []:
            owners[tuple(w[k : k + window])].add(str(i))
    out = []
    for d, t in rows:
        w = TERM.findall(lower(t))
        hit, found = [0] * len(w), set()
        for n in {len(x) for x in owners}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in owners:
                    hit[k : k + n] = [1] * n
                    found |= owners[tuple(w[k : k + n])]
        out.append((d, len(w), sum(hit), len(found), sha(",".join(sorted(found))), sum(hit) > 0))
    return out
