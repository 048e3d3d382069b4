"""Plain Python counterparts of the dealt operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), s)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def shingles(text: str | None, n: int) -> frozenset:
    w = words(lower(text or ""))
    m = min(n, len(w))
    return frozenset(tuple(w[i : i + m]) for i in range(len(w) - m + 1)) if w else frozenset()


def classes(docs: dict[int, str | None], n: int, percent: int) -> dict[int, int]:
    """Smallest id reachable by links, over all pairs that share a shingle."""
    sets = {i: shingles(t, n) for i, t in docs.items()}
    parent = {i: i for i in docs}

    def find(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    where = defaultdict(list)
    for i in sorted(sets):
        for j in {j for s in sets[i] for j in where[s]}:
            both = len(sets[i] & sets[j])
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            where[s].append(i)
    return {i: find(i) for i in docs}


def drop_lines(docs: list[str | None], least: int) -> list[tuple[str, int]]:
    key = lambda x: lower(x.strip(SPACE))
    seen = Counter(k for t in docs for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not key(x) or seen[key(x)] < least]
        out.append(("\n".join(kept), len(lines) - len(kept)))
    return out


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    t, w = text or "", words(text)
    lines = [x for x in t.split("\n") if words(x)]
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated)


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Over ordered sizes, by trying capacities."""

    def feasible(c: int) -> bool:
        used, left = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > left:
                used, left = used + 1, c
            left -= s
        return used <= shards

    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low
