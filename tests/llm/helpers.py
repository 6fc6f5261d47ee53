"""Plain versions of the operators, for comparison on small inputs."""

from __future__ import annotations

import re
from collections import defaultdict

LINE = "documents: doc_id bigint, text string"


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


def shingles(text: str | None, length: int = 5) -> set:
    w = words(text)
    return {tuple(w[i : i + length]) for i in range(max(1, len(w) - length + 1))} if w else set()


def components(nodes, links):
    """Smallest node reachable from each node."""
    low = {n: n for n in nodes}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    for n in sorted(nodes):
        stack = [n] if low[n] == n else []
        while stack:
            for m in near[stack.pop()]:
                if low[m] > n:
                    low[m] = n
                    stack.append(m)
    return low
