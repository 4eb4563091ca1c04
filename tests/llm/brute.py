"""Plain versions of the duplicate searches, for small tables."""

from collections import Counter
from itertools import combinations


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def weighted(text, size=5):
    w = text.lower().split()
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def brute_classes(texts, least=0.8):
    ids = sorted(texts)
    sets = {i: weighted(texts[i]) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(ids, 2):
        both, either = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
        if (either == 0 and texts[a].split() == texts[b].split()) or (either and both / either >= least):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
