"""Plain single-machine versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import sys
import zlib
from collections import Counter

sys.set_int_max_str_digits(0)  # plain int() of any length
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def contamination(docs, items):
    win = {}
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        for x in [tuple(w)] if 0 < len(w) < 10 else [tuple(w[k : k + 10]) for k in range(len(w) - 9)]:
            win.setdefault(x, set()).add(i)
    out = []
    for i, t in docs:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, own = set(), set()
        for n in {len(x) for x in win}:
            for s in range(len(w) - n + 1):
                if (x := tuple(w[s : s + n])) in win:
                    hit.update(range(s, s + n))
                    own |= win[x]
        out.append((i, len(w), len(hit), len(own), sha(",".join(sorted(map(str, own)))), bool(hit)))
    return out


def quality(docs):
    out = []
    for i, t in docs:
        t = t or ""
        w = SPACE.findall(t)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
        seen, dup = set(), 0
        for x in t.split("\n"):
            if SPACE.search(x):
                dup += x in seen
                seen.add(x)
        out.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)))
    return out


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def removed_lines(docs, tau=2, least=24):
    """doc_id -> places; docs with distinct non-null ids."""
    before, gone, seen = [], {}, set()
    for i, t in sorted((i, t) for i, t in docs if i is not None and t is not None):
        for k, x in enumerate(t.split("\n")):
            if x.strip() and x in seen:
                gone.setdefault(i, set()).add(k)
            seen.add(x)
            if len(x) >= least:
                if any(abs(len(x) - len(y)) <= tau and (x == y or edit_distance(x, y) <= tau) for y in before):
                    gone.setdefault(i, set()).add(k)
                before.append(x)
    return gone


def suffix_dedup(docs):
    first, out = {}, []
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        cov = bytearray(len(b))
        for k in range(len(b) - 49):
            if first.setdefault(b[k : k + 50], i) < i:
                cov[k : k + 50] = b"\1" * 50
        runs = len(re.findall(b"\1+", bytes(cov)))
        out.append((i, len(b), sum(cov), runs, sha(bytes(c for c, z in zip(b, cov) if not z))))
    return out


def shingles(t, size):
    w = (t or "").translate(LOWER).encode().split()
    if not w:
        return set()
    return {tuple(w)} if len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def components(docs, size=3, percent=90):
    sets = [(i, shingles(t, size)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [(i, len(s), find(i)) for i, s in sets]


def base_scores(docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = {i: (t or "").translate(LOWER).encode().split() + [b"\n"] for i, t in docs}
    c = Counter(w for i, _ in docs if not held(i) for w in tokens[i])
    n, v = sum(c.values()), len(c)
    return {i: (held(i), len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in w)) for i, w in tokens.items()}


def personal(text, luhn):
    digits = lambda s: re.findall("[0-9]", s)
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m[0])) <= 19 and luhn("".join(digits(m[0])))]
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m[0])) <= 15]
