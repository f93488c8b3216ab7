"""Plain versions of the operators, for small fixtures."""

import collections
import hashlib
import math
import re
import zlib

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def components(docs, width=5, percent=80):
    """doc_id: (set size, least id reachable)."""
    sets = {}
    for i, t in docs:
        w = SPACED.findall(low(t))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    owners = collections.defaultdict(list)
    for i, s in sets.items():
        for x in s:
            owners[x].append(i)
    for i, s in sets.items():
        for j, n in collections.Counter(j for x in s for j in owners[x] if j < i).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def contamination(docs, items, width=10):
    windows = collections.defaultdict(set)
    for key, t in items:
        w = ALNUM.findall(low(t))
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(key)
    out = {}
    for doc, t in docs:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= {str(k) for k in windows[tuple(w[i : i + n])] if k is not None}
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def measures(text):
    w = SPACED.findall(text or "")
    windows = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if SPACED.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


class Katz:
    """Bigrams in dictionaries; docs: id -> text."""

    def __init__(self, docs, discounts):
        self.docs = {k: [*SPACED.findall(low(t)), None] for k, t in docs.items()}
        self.held = {k: zlib.crc32(str(k).encode()) % 7 == 2 for k in docs}
        self.words, self.pairs, self.contexts = collections.Counter(), collections.Counter(), collections.Counter()
        for k, w in self.docs.items():
            if not self.held[k]:
                self.words.update(w)
                for h, x in zip([0, *w], w):
                    self.pairs[h, x] += 1
                    self.contexts[h] += 1
        self.n = sum(self.words.values())
        coc = lambda c: [sum(v == r for v in c.values()) for r in range(1, 7)]
        n1 = coc(self.words)
        self.d1, self.d2 = discounts(n1), discounts(coc(self.pairs))
        left = sum((1 - d) * r * c for r, d, c in zip(range(1, 6), self.d1, n1))
        self.unknown, self.total = (left / self.n, self.n) if left > 0 else (1 / (self.n + 1), self.n + 1)
        follow = collections.defaultdict(list)
        for (h, w), c in self.pairs.items():
            follow[h].append((w, c))
        self.back = {}
        for h, x in follow.items():
            rest = sum((1 - self.d2[c - 1]) * c for _, c in x if c <= 5) / self.contexts[h]
            den = self.contexts[h] if rest > 0 else self.contexts[h] + 1
            self.back[h] = ((rest or 1 / den) / (1 - sum(self.p1(w) for w, _ in x)), den)

    def p1(self, w):
        c = self.words[w]
        return (self.d1[c - 1] if c <= 5 else 1) * c / self.total if c else self.unknown

    def p(self, h, w):
        if not self.contexts[h]:
            return self.p1(w)
        c, (weight, den) = self.pairs[h, w], self.back[h]
        return (self.d2[c - 1] if c <= 5 else 1) * c / den if c else weight * self.p1(w)

    def score(self, k):
        w = self.docs[k]
        return sum(math.log10(self.p(h, x)) for h, x in zip([0, *w], w))

    def base(self, k):
        return sum(math.log10((self.words[x] + 1) / (self.n + len(self.words) + 1)) for x in self.docs[k])
