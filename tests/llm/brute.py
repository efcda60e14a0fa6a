"""Plain definitions of the operators' results, for small tables."""

import hashlib
from collections import defaultdict

BLANKS = b" \t\n\x0b\x0c\r"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=False):
    text = text or ""
    return (text.translate(LOWER) if lower else text).encode().split()


def repeats(rows, window=20):
    """doc_id -> (n_words, n_removed, sha256 of the kept words)."""
    first = {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    out = {}
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (d, i):
                gone[i : i + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def components(vertices, links):
    """vertex -> smallest vertex reachable."""
    up = {v: v for v in vertices}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {v: root(v) for v in vertices}


def shingles(text):
    w = words(text, lower=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def jaccard(rows):
    """doc_id -> (n_shingles, component_id)."""
    sets = {d: shingles(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    pairs = {(a, b) for group in holders.values() for a in group for b in group if a < b}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    of = components(sets, links)
    return {d: (len(s), of[d]) for d, s in sets.items()}


def boilerplate(rows, ratio, min_pages):
    """Position -> (n_lines, n_dropped, text) of (host, text) rows."""
    pages, holds = defaultdict(int), defaultdict(int)
    for host, t in rows:
        pages[host] += 1
        for line in {x.strip(" \t\r\x0b\x0c") for x in (t or "").split("\n")} - {""}:
            holds[host, line] += 1
    out = []
    for host, t in rows:
        if t is None:
            out.append((0, 0, None))
            continue
        ls = t.split("\n")
        bad = lambda x: holds[host, x] >= min_pages and holds[host, x] > ratio * pages[host]
        kept = [x for x in ls if not (x.strip(" \t\r\x0b\x0c") and bad(x.strip(" \t\r\x0b\x0c")))]
        out.append((len(ls), len(ls) - len(kept), "\n".join(kept)))
    return out


def longest_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]
