"""Plain Python versions that the operators are tested against."""

import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def components(rows):
    """{doc_id: (n_shingles, component_id)} by comparing all sets that share a shingle."""
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    same = {}
    for d in sorted(sets):
        if sets[d]:
            parent[find(d)] = find(same.setdefault(sets[d], d))
    index = {}
    for s, d in same.items():
        for g in s:
            index.setdefault(g, []).append(d)
    for s, d in same.items():
        near = {}
        for g in s:
            for o in index[g]:
                if o < d:
                    near[o] = near.get(o, 0) + 1
        for o, both in near.items():
            if 100 * both >= 80 * (len(s) + len(sets[o]) - both):
                parent[find(d)] = find(o)
    least = {}
    for d in sets:
        least[find(d)] = min(least.get(find(d), d), d)
    return {d: (len(s), least[find(d)]) for d, s in sets.items()}
