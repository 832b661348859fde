"""Plain versions of what the operators compute, for comparison on small inputs."""

from __future__ import annotations

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text: str | None, n: int) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def link_groups(texts: dict[int, str | None], n: int, num: int, den: int) -> dict[int, int]:
    """Smallest id reachable by links, comparing every pair."""
    sets = {i: shingle_set(t, n) for i, t in texts.items()}
    group = {i: i for i in texts}
    ids = sorted(texts)

    def find(a: int) -> int:
        while group[a] != a:
            a = group[a]
        return a

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            shared = len(x & y)
            if shared and den * shared >= num * (len(x) + len(y) - shared):
                a1, b1 = find(a), find(b)
                group[max(a1, b1)] = min(a1, b1)
    return {i: find(i) for i in ids}


def base_rules(text: str | None) -> tuple[int, int, int, int, int]:
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)
