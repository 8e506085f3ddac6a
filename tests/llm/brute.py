"""Plain Python answers, for small tables."""

from __future__ import annotations

import itertools


def shingle_set(text: str | None, k: int) -> set:
    found = (text or "").encode().lower().split()
    if len(found) < k:
        return {tuple(found)} if found else set()
    return {tuple(found[i : i + k]) for i in range(len(found) - k + 1)}


def jaccard_components(rows: list[tuple], k: int, num: int, den: int) -> list[tuple]:
    """(id, set size, smallest id of the component) of (id, text) rows, all pairs compared."""
    sets = [shingle_set(text, k) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    holders: dict = {}
    for i, own in enumerate(sets):
        for token in own:
            holders.setdefault(token, []).append(i)
    for i, own in enumerate(sets):
        shared: dict[int, int] = {}
        for token in own:
            for j in holders[token]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, both in shared.items():
            if den * both >= num * (len(own) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least: dict[int, int] = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    return [(key, len(sets[i]), least.get(root(i)) if sets[i] else key) for i, (key, _) in enumerate(rows)]


def nearest(rows: list[tuple], k: int) -> list[tuple]:
    """(query id, rank, id, distance) for the ids divisible by 100 of (id, vector) rows."""
    import numpy as np

    usable = [(i, np.array(v, float)) for i, v in rows if v is not None and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q, x in usable:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((y - x) ** 2).sum())), i) for i, y in usable if i != q)[:k]
            out += [(q, rank + 1, i, far) for rank, (far, i) in enumerate(near)]
    return sorted(out)


def without_repeats(rows: list[tuple], size: int) -> list[tuple]:
    """(id, bytes, removed bytes, removed runs, SHA-256 of the rest) of (id, text) rows."""
    import hashlib

    seen: dict[bytes, int] = {}
    data = [(i, (text or "").encode()) for i, text in rows]
    for _, own in data:
        for s in range(len(own) - size + 1):
            key = hashlib.blake2b(own[s : s + size], digest_size=16).digest()
            seen[key] = seen.get(key, 0) + 1
    out = []
    for i, own in data:
        gone = bytearray(len(own))
        for s in range(len(own) - size + 1):
            if seen[hashlib.blake2b(own[s : s + size], digest_size=16).digest()] > 1:
                gone[s : s + size] = b"\1" * size
        runs = sum(1 for s in range(len(own)) if gone[s] and (s == 0 or not gone[s - 1]))
        kept = bytes(b for b, g in zip(own, gone) if not g)
        out.append((i, len(own), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def sharing(rows: list[tuple], size: int) -> list[bool]:
    """Whether another of the (id, text) rows holds the same ``size`` words in a row."""
    runs = []
    for _, text in rows:
        found = (text or "").encode().lower().split()
        runs.append({tuple(found[i : i + size]) for i in range(len(found) - size + 1)})
    held: dict[tuple, int] = {}
    for run in itertools.chain(*runs):
        held[run] = held.get(run, 0) + 1
    return [any(held[run] > 1 for run in own) for own in runs]


def spelling(rows: list[tuple]) -> list[tuple]:
    """(word, form, root, n, near words, form's n) of (id, text) rows; near words by words that agree without one code point."""
    import collections
    import re
    import zlib

    counts: collections.Counter = collections.Counter()
    for key, text in rows:
        for found in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in found)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    near, without = collections.defaultdict(set), collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            without[i, rest].add(w)
            if rest in n:
                near[w].add(rest)
                near[rest].add(w)
    for group in without.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: b for w, b in best.items() if n[b] >= 5 * n[w]}

    def root(w: str) -> str:
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), c, len(near[w]), n[form[w]] if w in form else None) for w, c in n.items())


def clusters(rows: list[tuple], k: int = 16, rounds: int = 3, size: int = 64) -> tuple[list[tuple], list]:
    """(id, cluster, squared distance) of (id, vector) rows, and the centroids: every distance computed, in Python's integers."""
    import hashlib
    import math

    kept = []
    for key, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((key, [max(-(2**27), min(2**27, math.floor(64 * float(x)))) for x in v]))
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in (order + sorted(r for r in kept if r[0] is None))[:k]]
    for step in range(rounds + 1):
        found = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in kept]
        if step < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, c) in zip(kept, found) if c == j]
                if own:
                    centroids[j] = [sum(col) // len(own) for col in zip(*own)]
    return sorted(((key, c, d) for (key, _), (d, c) in zip(kept, found)), key=str), centroids


def templates(pages: list[tuple], least: int, pages_least: int) -> dict:
    """For each host of (host, token list) pages, all different: the tokens of its valid classes, by comparing vectors and orders pair by pair."""
    out = {}
    for host in {h for h, _ in pages}:
        own = [t for h, t in pages if h == host]
        classes: dict[tuple, list] = {}
        for token in {t for page in own for t in page}:
            classes.setdefault(tuple(page.count(token) for page in own), []).append(token)
        held = {v: set(ts) for v, ts in classes.items() if len(ts) >= least and sum(map(bool, v)) >= pages_least and 2 * sum(map(bool, v)) >= len(own)}
        for v in list(held):
            orders = set()
            for page in own:
                found = [t for t in page if t in held[v]]
                n = len(held[v])
                orders |= {tuple(found[i : i + n]) for i in range(0, len(found), n)}
            if len(orders) != 1 or len(set(next(iter(orders)))) != len(held[v]):
                del held[v]
        out[host] = {frozenset(ts) for ts in held.values()}
    return out
