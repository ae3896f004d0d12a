"""Plain versions of the operators over small fixtures."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def united(ids, links):
    parent = {i: i for i in ids}

    def root(u):
        while parent[u] != u:
            u = parent[u]
        return u

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def counted(text):
    w, seen, out = words(text), Counter(), set()
    for x in [tuple(w[k : k + 5]) for k in range(len(w) - 4)] if len(w) >= 5 else ([tuple(w)] if w else []):
        out.add((x, seen[x]))
        seen[x] += 1
    return out


def near_groups(texts, least=0.8, weighted=False):
    """Smallest id of each text's near-duplicate group; texts: id to text. weighted: shingles count as often as they occur."""
    sets = {i: (counted if weighted else shingles)(t) for i, t in texts.items()}
    where, links, same = defaultdict(list), [], defaultdict(list)
    for i, t in texts.items():
        same[t or ""].append(i)
        for x in sets[i]:
            where[x].append(i)
    links += [(g[0], x) for g in same.values() for x in g[1:]]
    for i, s in sets.items():
        common = Counter(j for x in s for j in where[x] if j < i)
        links += [(i, j) for j, n in common.items() if n / (len(s) + len(sets[j]) - n) >= least]
    return united(texts, links)


def repeated_words(texts, length=50):
    """For each text which of its words lie in a run of length words that another text has too."""
    at = defaultdict(set)
    w = {i: words(t) for i, t in texts.items()}
    for i, x in w.items():
        for k in range(len(x) - length + 1):
            at[tuple(x[k : k + length])].add(i)
    out = {}
    for i, x in w.items():
        out[i] = [False] * len(x)
        for k in range(len(x) - length + 1):
            if len(at[tuple(x[k : k + length])]) > 1:
                out[i][k : k + length] = [True] * length
    return out
