"""Plain versions of operators, from their definitions, for small tables."""

from collections import Counter

import xxhash

SPACE = str.maketrans("\t\n\x0b\x0c\r", " " * 5)


def words(t):
    return [w for w in (t or "").translate(SPACE).split(" ") if w]


def item_matches(docs, items):
    """{(doc_id, item_id, similarity)}: every window of an item's length against every item, by similarity alone."""
    grams = lambda v, k: Counter(tuple(v[j : j + k]) for j in range(len(v) - k + 1))
    found = set()
    for item_id, text in items:
        item = words((text or "").lower())
        k = min(5, len(item))
        b = grams(item, k)
        for i, t in docs.items():
            w = words((t or "").lower())
            n = min(len(item), len(w))
            if not item or n < k:
                continue
            a, both, best = Counter(), 0, 0.0
            gram = [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]
            for j, g in enumerate(gram):  # a window more on the right, one less on the left
                a[g] += 1
                both += a[g] <= b[g]
                if j >= n - k + 1:
                    old = gram[j - (n - k + 1)]
                    both -= a[old] <= b[old]
                    a[old] -= 1
                if j >= n - k:
                    best = max(best, both / (n - k + 1 + len(item) - k + 1 - both))
            if best >= 0.8:
                found.add((i, item_id, round(best, 9)))
    return found


def simhash_components(docs):
    """{doc_id: (fingerprint in hex, component_id)}: every pair of fingerprints compared."""
    prints = {}
    for i, t in docs.items():
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        h = [xxhash.xxh64_intdigest(" ".join(w[j : j + 3]).encode(), 42) for j in range(max(1, len(w) - 2))] if w else []
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((of(a), of(b)))
                root[y] = x
    return {i: (f"{prints[i]:016x}", of(i)) for i in ids}


def inclusion(cells, targets, share, rounds):
    """{categories: probability} for cells {categories: tokens}: one margin's weights after another scaled to its shares, then all by one
    factor, at most 1 each, found by halving. A category outside the targets is None and keeps its natural share."""
    total, weight = sum(cells.values()), dict.fromkeys(cells, 1.0)
    wanted = []
    for axis, target in enumerate(targets.values()):
        now = Counter()
        for c, n in cells.items():
            now[c[axis]] += n
        free = sum((now[k] / total) ** 0.5 for k, v in target.items() if v is None)
        left = max(0.0, 1 - sum(v for v in target.values() if v is not None))
        want = {k: (now[k] / total) ** 0.5 / free * left if v is None else v for k, v in target.items()}
        listed, natural = sum(want.values()), now[None] / total
        wanted.append({k: v / listed * (1 - natural) for k, v in want.items()} | {None: natural})
    for _ in range(rounds):
        worst = 0.0
        for axis, want in enumerate(wanted):
            now = Counter()
            for c, n in cells.items():
                now[c[axis]] += weight[c] * n
            met = sum(want[k] for k, n in now.items() if n)
            for c, n in cells.items():
                if n:
                    factor = want[c[axis]] / met * total / now[c[axis]]
                    weight[c] *= factor
                    worst = max(worst, abs(factor - 1))
        if worst < 1e-12:
            break
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        kept = sum(min(1.0, mid * weight[c]) * n for c, n in cells.items())
        low, high = (mid, high) if kept < share * total else (low, mid)
    return {c: min(1.0, low * weight[c]) if n else 1.0 for c, n in cells.items()}
