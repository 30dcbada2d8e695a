"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def low_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i in range(len(w) - 2) if grams[w[i], w[i + 1], w[i + 2]] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    chars = sum(len(x.decode()) for x in w)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(w), chars, symbols, dup, len(repeated), len(w) < 50 or 100 * len(repeated) > 50 * len(w)


def without_repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[p:p + length] for b in raw for p in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = [False] * len(b)
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = [True] * length
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shingles(text: str | None, k: int = 2) -> frozenset:
    w = low_words(text)
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def groups(rows: list[tuple[int, str | None]], percent: int = 80, k: int = 2) -> list[tuple[int, int, int, bool]]:
    """(id, shingles, component, kept) by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    return [(r[0], len(sets[i]), min(members[find(i)]), r[0] == min(members[find(i)])) for i, r in enumerate(rows)]


def base_scores(rows: list[tuple[str | None, bool]]) -> list[tuple[int, int, int, float]]:
    """n_tokens, n_known, train_tokens and base score; rows are (text, held out)."""
    tokens = [[*low_words(t), None] for t, _ in rows]
    c = Counter(x for (_, held), ts in zip(rows, tokens) if not held for x in ts)
    n, v = sum(c.values()), len(c)
    return [(len(ts), sum(c[x] > 0 for x in ts), n, sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)) for ts in tokens]


def targets(sizes: dict, weights=(5, 2, 1), percent: int = 150) -> dict:
    """Shares by weight, with what is above twice a source's size shared again until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped, left = {}, set(order)
    while left:
        rest = sum(sizes.values()) * percent / 100 - sum(capped.values())
        unit = rest / sum(weight[s] for s in left)
        over = {s for s in left if unit * weight[s] > 2 * sizes[s]}
        if not over:
            return capped | {s: unit * weight[s] for s in left}
        capped |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return capped
