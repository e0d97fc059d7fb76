"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered(sequence, length, repeated):
    gone = [False] * len(sequence)
    for i in range(len(sequence) - length + 1):
        if repeated(sequence[i : i + length]):
            gone[i : i + length] = [True] * length
    return gone


def spans(gone):
    found, start = [], None
    for i, g in enumerate([*gone, False]):
        if g and start is None:
            start = i
        elif not g and start is not None:
            found.append((start, i))
            start = None
    return found


def without_repeats(sequences, length):
    """Per sequence: what is removed, by place."""
    seen = Counter(tuple(s[i : i + length]) for s in sequences for i in range(len(s) - length + 1))
    return [covered(s, length, lambda w: seen[tuple(w)] > 1) for s in sequences]


def without_repeated_bytes(texts, length):
    seen = Counter()
    digest = lambda b: hashlib.blake2b(b, digest_size=16).digest()
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[digest(t[i : i + length])] += 1
    return [covered(t, length, lambda w: seen[digest(w)] > 1) for t in texts]


def shingles(text, n=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def least_reachable(nodes, links):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    found = {}
    for start in sorted(nodes):
        if start in found:
            continue
        todo = [start]
        while todo:
            node = todo.pop()
            if node not in found:
                found[node] = start
                todo += near[node]
    return found
