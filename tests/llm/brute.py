"""Plain Python versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring_dedup(rows, size=20):
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text) rows."""
    docs = [(d, WORD.findall(t or "")) for d, t in rows]
    def when(d, s):
        return (d is None, d or 0, s)
    first = {}
    for d, w in docs:
        for s in range(len(w) - size + 1):
            k = tuple(w[s:s + size])
            first[k] = min(first.get(k, when(d, s)), when(d, s))
    out = []
    for d, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - size + 1):
            if first[tuple(w[s:s + size])] < when(d, s):
                gone[s:s + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def shingles(text, n=5):
    words = re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", (text or "").lower()).split()
    if not words:
        return Counter()
    return Counter([tuple(words)]) if len(words) < n else Counter(zip(*[words[i:] for i in range(n)]))


def contained(docs, items, threshold=0.8):
    """(doc_id, item_id, shared, size) of contained items."""
    wanted = [(i, set(shingles(t))) for i, t in dict.fromkeys(items)]
    out = []
    for d, t in docs:
        own = set(shingles(t))
        for i, q in wanted:
            if q and len(q & own) >= threshold * len(q) - 1e-9:
                out.append((d, i, len(q & own), len(q)))
    return out


def near_classes(rows, threshold=0.8):
    """doc_id -> class id by all pairs and union-find; rows have unique non-null ids."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    ids = sorted(d for d in sets if sets[d])
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            x, y = sets[a], sets[b]
            small, large = sorted((sum(x.values()), sum(y.values())))
            if small >= threshold * large and sum((x & y).values()) >= threshold * sum((x | y).values()) - 1e-9:
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: root(d) for d in sets}


def top_k(rows, queries, k=5):
    """(query_id, rank, vec_id, score) of (id, integer vector) rows."""
    out = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in rows if c != q and len(w) == len(v))
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return out


def phrases(rows, min_count=30, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (lang, text) rows."""
    upper = {c: c + 32 for c in range(65, 91)}
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(upper)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f.update((lang, tuple(w[i:i + k])) for i in range(len(w) - k + 1))
    some = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= min_count}
    out = {}
    for (lang, w), a in some.items():
        if any(la == lang and len(v) > len(w) and 100 * b >= 80 * a
               and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1)) for (la, v), b in some.items()):
            continue
        score, _, le, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]])
                              for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), le, r))
    return [(lang, i + 1, p.decode(), -a, le, r, n[lang], -s)
            for lang, found in out.items() for i, (s, a, p, le, r) in enumerate(sorted(found)[:top])]


def merkle(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of (doc_id, source, lang, n_chars, text)."""
    import zlib

    def h(parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def leaf(row):
        return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)

    def climb(nodes):
        """All levels, the leaves first."""
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([h(levels[-1][a:a + 16]) for a in range(0, len(levels[-1]), 16)])
        return levels

    def steps(levels, at):
        for level in levels[:-1]:
            a = at // 16 * 16
            yield at - a, [x for i, x in enumerate(level[a:a + 16]) if i != at - a]
            at //= 16

    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((leaf(row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in order:
        groups[s].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees.append(climb([x for x, _ in groups[s]]))
    top = climb([t[-1][0] for t in trees]) if trees else []
    out = []
    for k, s in enumerate(order):
        for i, (own, row) in enumerate(groups[s]):
            path = [*steps(trees[k], i), *steps(top, k)]
            x = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                x = leaf((*row[:4], row[4] and row[4].translate({c: c + 32 for c in range(65, 91)})))
            for at, others in path:
                x = h([*others[:at], x, *others[at:]])
            out.append((row[0], own, trees[k][-1][0], top[-1][0], h(y for _, o in path for y in o), x, x == top[-1][0]))
    return out
