"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re
from collections import Counter

import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingles(text: str | None, k: int) -> set:
    w = words(text)
    return ({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}) if w else set()


def jaccard_components(rows: list[tuple[int, str | None]], k: int, percent: int) -> dict[int, tuple[int, int]]:
    """id -> (set size, smallest id reachable), by comparing every pair that shares a shingle."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict = {}
    for i, own in sets.items():
        for x in own:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for own in holders.values() for p, a in enumerate(own) for b in own[p + 1 :]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * len(sets[a] | sets[b]):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def exact_groups(rows: list[tuple]) -> dict:
    """normalised text -> ids in order of staying."""
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is not None, i or 0, i))
    return {k: [x[-1] for x in sorted(v)] for k, v in groups.items()}


def mix_targets(sizes: dict, share: float, most: float, weights: tuple) -> dict:
    """Resharing round by round until nothing is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while free and left > 1e-9:
        total = sum(w[s] for s in free)
        give = {s: left * w[s] / total for s in free}
        left = 0.0
        for s in list(free):
            target[s] += give[s]
            if target[s] >= most * sizes[s] - 1e-12:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                free.discard(s)
    return target


def cut(text: str | None, reach: int, pair_hash) -> list[list[str]]:
    """Paragraphs as lists of words: a word begins one where its hash with the word before is a first minimum near by."""
    own = words(text)
    if not own:
        return []
    h = [None] + [pair_hash(a, b) for a, b in zip(own, own[1:], strict=False)]
    out = [[own[0]]]
    for i in range(1, len(own)):
        before = [x for x in h[max(1, i - reach) : i]]
        after = h[i + 1 : i + reach + 1]
        if all(h[i] < x for x in before) and all(h[i] <= x for x in after):
            out.append([])
        out[-1].append(own[i])
    return out


def repeated_chains(rows: list[tuple], min_words: int, k: int, percent: int, reach: int, pair_hash) -> list[tuple]:
    """(doc_id, para, paras, n_words, cluster_doc, cluster_para, n_copies, removed) of each stretch of repeated paragraphs."""
    paras = {(r, i, n): p for r, (i, t) in enumerate(rows) if i is not None for n, p in enumerate(cut(t, reach, pair_hash))}
    sets = {x: shingles(" ".join(p), k) for x, p in paras.items()}
    parent = {x: x for x in paras}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders: dict = {}
    for x, own in sets.items():
        for g in own:
            holders.setdefault(g, []).append(x)
    for a, b in {(a, b) for own in holders.values() for p, a in enumerate(own) for b in own[p + 1 :]}:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    members: dict = {}
    for x in paras:
        members.setdefault(find(x), []).append(x)
    found = {x: (min(y[1:] for y in own), len(own)) for own in members.values() if len(own) > 1 for x in own}
    out, seen = [], set()
    for r, row in enumerate(rows):
        if row in seen:
            continue
        seen.add(row)
        chain: list = []
        for n in range(10**6):
            x = (r, row[0], n)
            if x in found:
                chain.append(x)
                continue
            if sum(len(paras[y]) for y in chain) >= min_words:
                stretch: list = []
                for y in [*chain, None]:
                    if stretch and (y is None or (found[y][0] != y[1:]) != (found[stretch[0]][0] != stretch[0][1:])):
                        head = min(found[z][0] for z in stretch)
                        out.append((row[0], stretch[0][2], len(stretch), sum(len(paras[z]) for z in stretch), *head, max(found[z][1] for z in stretch), found[stretch[0]][0] != stretch[0][1:]))
                        stretch = []
                    stretch.append(y)
            chain = []
            if x not in paras:
                break
    return out


def toxicity(rows: list[tuple], labels: dict, k: int, floor: float) -> list[tuple]:
    """doc_id and score of every row: cosines to all labelled rows over all of their words; ids are unique."""
    bags = {i: Counter(regex.findall(r"\p{L}+", (t or "").lower())) for i, t in rows}
    known = {i: labels[i] for i in bags if i in labels}
    bad = sum(known.values())
    share, weight = bad / max(len(known), 1), {}
    for term in {t for i in known for t in bags[i]}:
        held = sum(term in bags[i] for i in known)
        toxic = sum(term in bags[i] for i in known if known[i])
        favour = max((toxic - held * share) / math.sqrt(held * share * (1 - share) + 1), 0)
        weight[term] = (math.log((len(rows) + 1) / (sum(term in b for b in bags.values()) + 1)) + 1) * (floor + favour)
    vectors = {}
    for i, bag in bags.items():
        own = {t: (1 + math.log(n)) * weight[t] for t, n in bag.items() if t in weight}
        norm = math.sqrt(sum(w * w for w in own.values()))
        vectors[i] = {t: w / norm for t, w in own.items()}
    prior, out = bad / (len(known) + 1), []
    for i, own in vectors.items():
        sims = [(sum(w * vectors[e].get(t, 0) for t, w in own.items()), known[e]) for e in known if e != i]
        near = sorted(((-round(s, 10), y) for s, y in sims if s > 0))[:k]
        votes = [(1 / (1.05 + min(max(s, -1.0), 0.0)), y) for s, y in near]
        out.append((i, (sum(v * y for v, y in votes) + prior) / (sum(v for v, _ in votes) + 1)))
    return out
