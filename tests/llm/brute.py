"""Plain versions of operators, for small inputs."""

import math
import re
import zlib
from collections import Counter, defaultdict

_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))


def jaccard_components(rows, n, percent):
    sets, parent = {}, {}
    for k, t in rows:
        w = words(t)
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
        parent[k] = k

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {k: (len(sets[k]), find(k)) for k in keys}


def suffix_tree_scores(rows, least=2, gain=1.0, b=0.5, depth=5):
    texts = {k: (*words(t), None) for k, t in rows}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in texts}
    c = [Counter() for _ in range(depth + 1)]
    for k, w in texts.items():
        if not held[k]:
            for n in range(1, depth + 2):
                c[n - 1].update(zip(*(w[i:] for i in range(n)), strict=False))
    total = sum(c[0].values())
    z = total + 0.5 * (len(c[0]) + 1)
    twice = lambda gram: x if (x := c[len(gram) - 1][gram]) > 1 else 0
    follows = defaultdict(list)
    for grams in c[1:]:
        for gram, x in grams.items():
            follows[gram[:-1]].append((gram, x))
    kept = {}
    for s, own in follows.items():
        seen, once = sum(x for _, x in own), sum(x == 1 for _, x in own)
        if seen < least:
            continue
        g = once * math.log10(max(once - 1 + b, b)) - seen * math.log10(seen - 1 + b)
        for gram, x in own:
            if x > 1:
                shorter = [(c[0][gram[-1:]] + 0.5) / z, *(twice(gram[k:]) / (c[len(s) - k - 1][s[k:]] + b) for k in range(1, len(s)))]
                g += x * math.log10((x - 1) / max(shorter))
        if g > gain:
            kept[s] = seen, once
    out = {}
    for k, w in texts.items():
        base = score = 0.0
        for i, x in enumerate(w):
            p = (c[0][(x,)] + 0.5) / z
            base += math.log10(p)
            for n in range(1, depth + 1):
                if i >= n and (s := w[i - n : i]) in kept:
                    p = (twice((*s, x)) + (kept[s][1] + b) * p) / (kept[s][0] + b)
            score += math.log10(p)
        out[k] = held[k], len(w), sum(c[0][(x,)] > 0 for x in w), total, base, score
    return out
