"""Plain Python versions of the mix, the permutation and the near-duplicate classes, for small tables."""

import math
import re
import struct

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(*parts):
    """The engine's xxhash64 of columns: ("i", int), ("q", long) or text; each hash seeds the next."""
    h = 42
    for p in parts:
        data = p.encode() if isinstance(p, str) else struct.pack("<" + p[0], p[1])
        h = xxhash.xxh64_intdigest(data, seed=h)
    return signed(h)


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def row_id(i, t):
    return i if i is not None else (1 << 62) + ((spark_hash(t) & (1 << 64) - 1) >> 2)


def fingerprint(t):
    w = words(t)
    grams = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(marks):
    """Item -> one item of its component; items are linked at 4 or fewer differing bits."""
    parent = {x: x for x in marks}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = list(marks)
    for n, x in enumerate(items):
        for y in items[:n]:
            if (marks[x] ^ marks[y]).bit_count() <= 4:
                parent[root(x)] = root(y)
    return {x: root(x) for x in items}


def goals(totals):
    """Source -> (target, slope) of the water level: weights 3, 1, 2 in turn, 150 % of all, twice the source at most."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    slope = {s: (0.5, -0.5, 0.0)[i % 3] for i, s in enumerate(order)}
    left, active, target = 1.5 * sum(totals.values()), set(order), {}
    while active:
        level = left / sum(weight[s] for s in active)
        full = {s for s in active if level * weight[s] >= 2 * totals[s]}
        for s in full or active:
            target[s] = 2.0 * totals[s] if full else level * weight[s]
        left -= sum(target[s] for s in full)
        active = active - full if full else set()
    return {s: (target[s], slope[s]) for s in order}


def mix(rows):
    """rows: (id, text, source).  For each: (size, source_size, target, positions of its copies)."""
    sizes = [len(words(t)) for _, t, _ in rows]
    totals = {}
    for (_, _, s), n in zip(rows, sizes):
        totals[s] = totals.get(s, 0) + n
    goal = goals(totals)
    per = max(6, min(24, (max(1, len(rows)) // 20_000).bit_length()))
    out = [None] * len(rows)
    for s, total in totals.items():
        target, slope = goal[s]
        passes = math.floor((target / total if total else 0) + 1e-12)
        part = left = target - passes * total
        own = []
        for k in (k for k in range(len(rows)) if rows[k][2] == s):
            i, t, _ = rows[k]
            i = -(2**63) if i is None else i
            h = spark_hash(("i", 8), ("q", i), *([] if t is None else [t])) & (1 << 64) - 1
            own.append((sizes[k], h, i, k))
        run = []
        for n, h, i, k in sorted((x for x in own if x[0] * 200 > total), key=lambda x: (-x[0], signed(x[1]), x[2])):
            fits = n <= left
            left -= n if fits else 0
            run.append(((-1 if fits else 1 << 40), h >> 1, signed(h), i, n, k))
        for n, h, i, k in (x for x in own if x[0] * 200 <= total):
            rest = h << per & (1 << 64) - 1
            run.append((h >> (64 - per), rest >> 1, signed(rest), i, n, k))
        done = 0
        for *_, n, k in sorted(run):
            middle = done + n / 2
            done += n
            copies = min(2, passes + (middle < part)) if n and target > 0 else 0
            out[k] = n, total, target, [position(middle + c * total, target, slope) for c in range(copies)]
    return out


def position(done, target, slope):
    u = min(1.0, max(0.0, done / target))
    return u if slope == 0 else (math.sqrt((1 - slope) ** 2 + 4 * slope * u) - (1 - slope)) / (2 * slope)


def permuted(x, n, seed):
    """The Feistel permutation of [0, n) with cycle walking."""
    if n < 2:
        return x
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        left, right = divmod(x, b)
        for i in range(6):
            key = spark_hash(("i", seed), ("i", i))
            if i % 2 == 0:
                left = (left + spark_hash(("q", key), ("q", right)) % a) % a
            else:
                right = (right + spark_hash(("q", key), ("q", left)) % b) % b
        x = left * b + right
        if x < n:
            return x
