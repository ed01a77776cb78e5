"""Plain Python versions of the numbered problems, for small tables."""

import json
import re
from collections import defaultdict

import regex

WORD = regex.compile(r"[\p{L}\p{N}]+")
LABEL = re.compile(r"(?im)^(?=[ \t]*(?:title|description|source|language|code)[ \t]*:)")


def squash(x):
    return regex.sub(r"[^\p{L}\p{N}]+", "", x.upper())


def blank(x):
    return x is None or not x.strip()


class Components:
    def __init__(self):
        self.up = {}

    def root(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def _sorted_json(v):
    if isinstance(v, dict):
        return "{" + "|".join(sorted(squash(k) + ":" + _sorted_json(x) for k, x in v.items())) + "}"
    if isinstance(v, list):
        return "[" + "|".join(map(_sorted_json, v)) + "]"
    return squash(v if isinstance(v, str) else json.dumps(v))


def forms(title, content):
    out = [("flat", squash(title), squash(content))]
    try:
        v = json.loads(content)
        if isinstance(v, dict):
            out.append(("json", squash(title), _sorted_json(v)))
    except ValueError:
        pass
    parts = LABEL.split(content)
    if len(parts) > 1:
        out.append(("fields", squash(title), tuple(sorted(filter(None, map(squash, parts))))))
    return out


def same_entries(rows):
    """rows: (entry_id, title, content); the components of entries that agree in any form."""
    c, by = Components(), {}
    for e, t, x in rows:
        if e is None or blank(t) or blank(x):
            continue
        c.root(e)
        for f in forms(t, x):
            c.join(e, by.setdefault(f, e))
    return c


def groups(c):
    g = defaultdict(set)
    for e in c.up:
        g[c.root(e)].add(e)
    return {k: v for k, v in g.items() if len(v) > 1}


def p1(rows):
    return {(k, e) for k, v in groups(same_entries(rows)).items() for e in v if e != k}


def shingles(x):
    w = [m.upper() for m in WORD.findall(x)]
    return frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def likeness(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def alike_pairs(sets, at_least=0.7):
    """All pairs of keys of ``sets`` that are alike, by an inverted index over every member."""
    post, out = defaultdict(list), set()
    for k, s in sets.items():
        for m in s:
            post[m].append(k)
    n = defaultdict(int)
    for ks in post.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                n[a, b] += 1
    for (a, b), common in n.items():
        if common / (len(sets[a]) + len(sets[b]) - common) >= at_least - 1e-12:
            out.add((a, b))
    return out


def p5(rows):
    sets, by = {}, defaultdict(list)
    for e, _, x in rows:
        if e is not None and not blank(x) and shingles(x):
            by[shingles(x)].append(e)
    c = same_entries(rows)
    for s, es in by.items():
        sets[es[0]] = s
        for e in es:
            c.join(es[0], e)
    for a, b in alike_pairs(sets):
        c.join(a, b)
    return {(k, e) for k, v in groups(c).items() for e in v}


def p2(rows, cutoff):
    """rows: (cache_id, time, content)."""
    order = sorted((t, i, shingles(x)) for i, t, x in rows if t is not None and i is not None and x and shingles(x))
    post, accepted, out = defaultdict(list), {}, set()
    for t, i, s in order:
        n = defaultdict(int)
        if t >= cutoff:
            for m in s:
                for j in post[m]:
                    n[j] += 1
        hits = [j for j, common in n.items() if common / (len(s) + len(accepted[j]) - common) >= 0.7 - 1e-12]
        if hits:
            out |= {(min(i, j), max(i, j)) for j in hits}
        else:
            accepted[i] = s
            for m in s:
                post[m].append(i)
    return out


def p3(rows):
    """rows: (id, library_id, content, indexed_at)."""
    latest = {}
    for i, lib, x, t in rows:
        if i is not None and (i not in latest or latest[i][2] < t):
            latest[i] = (lib, x, t)
    docs, n = defaultdict(set), defaultdict(int)
    key = lambda line: regex.sub(r"\P{L}+", "", line.upper())
    for i, (lib, x, _) in latest.items():
        if lib is not None:
            n[lib] += 1
            for line in (x or "").split("\n"):
                docs[lib, key(line)].add(i)
    out = set()
    for i, (lib, x, _) in latest.items():
        for k, line in enumerate((x or "").split("\n")):
            if lib is not None and len(key(line)) >= 15 and len(docs[lib, key(line)]) >= max(12, 0.1 * n[lib] - 1e-9):
                out.add((i, k))
    return out
