"""Plain single-machine versions of the operators, to hold them against."""

import re
from collections import Counter, defaultdict

SPACES = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def shingles(text, k):
    w = re.findall(SPACES, lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def near_duplicates(docs, k, percent):
    """doc_id to (n_shingles, component_id); docs: list of (doc_id, text) with distinct ids."""
    sets = {d: shingles(t, k) for d, t in docs}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def hits(text, items, size=10):
    """(number of words, hit words, items with a window) of one text; items: list of (item_id, text)."""
    w = re.findall(ALNUM, lower(text or ""))
    hit, own = set(), set()
    for item, t in items:
        v = re.findall(ALNUM, lower(t or ""))
        n = min(size, len(v))
        for s in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[s : s + n]:
                    hit.update(range(p, p + n))
                    own.add(item)
    return len(w), hit, own


def dropped_lines(docs, min_docs=2, depth=1, min_bytes=16):
    """Per document (by place) the numbers of the lines that go."""
    blank = " \t\x0b\x0c\r"

    def tokens(line):
        s = line.strip(blank)
        t = tuple("<*>" if re.search("[0-9]", x) else x for x in re.split(f"[{blank}]+", s))
        return t if len(s.encode()) >= min_bytes and 2 * t.count("<*>") <= len(t) else None

    def parts(t):
        n, of = len(t), len(t) // 5 + 1
        return [(n, t[:depth], q, t[q * n // of : (q + 1) * n // of]) for q in range(of)]

    holding, variants = defaultdict(set), defaultdict(set)
    for _, text in docs:
        for line in (text or "").split("\n"):
            if t := tokens(line):
                holding[t].add(text)
                for p in parts(t):
                    variants[p].add(t)
    seen = Counter()
    candidates = [t for t in holding if len(t) >= 5 and any(len(variants[p]) > 1 for p in parts(t))]
    for t in candidates:
        for i, x in enumerate(t):
            if x != "<*>":
                seen[len(t), t[:depth], i, x] += len(holding[t])
    template, texts, first = {t: (False, t) for t in holding}, defaultdict(set), {}
    for t in candidates:
        n = len(t)
        counts = [seen[n, t[:depth], i, x] for i, x in enumerate(t)]
        need = max((n + 1) // 2, n - t.count("<*>") - n // 5)
        level = sorted(counts)[-need]
        template[t] = level > 1 and (True, tuple(x if c > 1 and 2 * c >= level else "<*>" for x, c in zip(t, counts, strict=True)))
    for d, text in docs:
        for line in (text or "").split("\n"):
            if k := template.get(tokens(line)):
                texts[k].add(text)
                first[k] = min(first.get(k, d), d)
    goes = {t for t, k in template.items() if k and len(texts[k]) >= min_docs}
    return [[i for i, line in enumerate(t.split("\n")) if (k := tokens(line)) in goes and first[template[k]] != d] if t is not None else [] for d, t in docs]


def targets(sizes, weights, share, passes):
    """source to (size, target), by sharing again and again what lies above a source's limit."""
    total = Counter()
    for s, n in sizes:
        total[s] += n
    order = sorted((s for s in total if s is not None), key=lambda s: s) + ([None] if None in total else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, budget = set(), share * sum(total.values())
    while True:
        left = budget - sum(passes * total[s] for s in full)
        open_ = [s for s in order if s not in full]
        got = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        more = {s for s in open_ if got[s] > passes * total[s]}
        if not more:
            return {s: (total[s], got.get(s, passes * total[s])) for s in order}
        full |= more
