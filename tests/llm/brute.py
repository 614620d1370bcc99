"""The operators' results the plain way, on small tables."""

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from itertools import combinations

import numpy as np
import xxhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def components(ids, linked):
    parent = {i: i for i in ids}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def warc(pages):
    digest = {p: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode() for p, h in pages}
    first = {}
    for p in sorted(digest):
        first.setdefault(digest[p], p)
    return {(p, len((h or "").encode()), digest[p], "response" if first[digest[p]] == p else "revisit", None if first[digest[p]] == p else first[digest[p]]) for p, h in pages}


def simhash(text, words=3):
    w = WORD.findall((text or "").encode().lower())
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_components(docs, words=3, budget=2):
    fp = {d: simhash(t, words) for d, t in docs}
    values = sorted(set(fp.values()))
    linked = [(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= budget]
    group = components(values, linked)
    least = defaultdict(lambda: 1 << 62)
    for d, f in fp.items():
        least[group[f]] = min(least[group[f]], d)
    return {(d, f"{f:016x}", least[group[f]]) for d, f in fp.items()}


def substrings(docs, window=35):
    words = {d: WORD.findall((t or "").encode()) for d, t in docs}
    seen = Counter(tuple(w[i : i + window]) for w in words.values() for i in range(len(w) - window + 1))
    out = set()
    for d, w in words.items():
        gone = np.zeros(len(w), dtype=bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.add((d, len(w), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return out


def nearest(rows, every, k, integer=False):
    def use(v):
        return v is not None and all(x is not None and np.isfinite(x) for x in v) and (integer or any(v))

    vectors = {i: [float(x) for x in v] for i, v in rows if use(v)}
    if integer:
        vectors = {i: [int(Fraction(x) * 256 // 1) for x in v] for i, v in vectors.items()}

    def product(a, b):
        total = 0 if integer else 0.0
        for x, y in zip(a, b, strict=True):
            total += x * y
        return total

    out = {}
    for q in sorted(i for i in vectors if i % every == 0):
        scores = sorted((-product(vectors[q], v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:k]
        for rank, (s, i) in enumerate(scores, 1):
            out[q, rank] = (i, -s)
    return out


def pieces(docs, encode, capacity=1024, end=2):
    out = set()
    for d, t in docs:
        ids = [*encode(t or ""), end]
        first = len(ids) % capacity or min(capacity, len(ids))
        for i, a in enumerate([0, *range(first, len(ids), capacity)]):
            part = np.array(ids[a : first if not i else a + capacity], dtype="<u4")
            out.add((d, i, a, len(part), zlib.crc32(part.tobytes())))
    return out


def mixing(tokens, shares, fraction):
    """Inclusion probability of each cell. tokens: by (level, ...) cell; shares: by dimension and level. Targets are capped by
    what a level has, factors found by bisection, one dimension after the other until nothing moves."""

    def least_factor(sizes, weights, budget):
        low, high = 0.0, 1e6
        for _ in range(70):
            mid = (low + high) / 2
            got = sum(min(s, mid * w) for s, w in zip(sizes, weights, strict=True))
            low, high = (mid, high) if got < budget else (low, mid)
        return high

    total, dims, aims = sum(tokens.values()), range(len(next(iter(tokens)))), []
    for d in dims:
        levels = {}
        for cell, t in tokens.items():
            levels[cell[d]] = levels.get(cell[d], 0) + t
        share = {x: shares[d].get(x, 0.0) for x in levels}
        m = least_factor(list(levels.values()), [share[x] for x in levels], fraction * total)
        aims.append({x: min(levels[x], m * share[x]) for x in levels})
    w = {c: float(all(aims[d][c[d]] > 0 for d in dims)) for c in tokens}
    for _ in range(80):
        for d in dims:
            for x, aim in aims[d].items():
                cells = [c for c in tokens if c[d] == x and w[c] > 0]
                if cells:
                    m = least_factor([tokens[c] for c in cells], [tokens[c] * w[c] for c in cells], aim)
                    for c in cells:
                        w[c] *= m
    return {c: min(1.0, x) for c, x in w.items()}, aims


def minimax(sizes, shards):
    """Smallest largest run over all contiguous partitions, by dynamic programming."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    best = ends.copy()
    for _ in range(shards - 1):
        best = np.array([min(max(best[j], ends[i] - ends[j]) for j in range(i + 1)) for i in range(len(ends))])
    return int(best[-1])


def normalised(line):
    import regex

    return regex.sub(r"[^\p{L}]+", " ", line.lower()).strip(" ")


def line_blocks(norm):
    """The four blocks of a line's SimHash: of each quarter of its words (of its letters, if it has under four words) the bits
    that over half have, of the bits i and 16, 32, 48 more, i in 4b to 4b + 3."""
    words = norm.split(" ")
    words = words if len(words) >= 4 else list(norm)
    out = []
    for b in range(4):
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for i, w in enumerate(words) if i * 4 // len(words) == b]
        out.append(tuple(2 * sum(h >> (i + 16 * j) & 1 for h in hashes) > len(hashes) for i in range(4 * b, 4 * b + 4) for j in range(4)))
    return out


def edit_distance(a, b):
    if abs(len(a) - len(b)) > 0.5 * max(len(a), len(b)):
        return max(len(a), len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def close(a, b, most):
    """Whether a and b are at most `most` edits apart: rows of the table of distances, all of a row at once."""
    if abs(len(a) - len(b)) > most:
        return False
    x, y = (np.frombuffer(t.encode("utf-32-le"), dtype="<u4") for t in (a, b))
    ramp = np.arange(len(y) + 1)
    row = ramp.copy()
    for i in range(len(x)):
        step = np.minimum(row[1:] + 1, row[:-1] + (y != x[i]))
        row = np.minimum.accumulate(np.concatenate([[i + 1], step]) - ramp) + ramp
    return bool(row[-1] <= most)


def fuzzy_lines(docs, min_chars=20, changed=2, similarity=0.8):
    places = defaultdict(list)
    for d, t in sorted(docs, key=lambda x: x[0]):
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            if len(n := normalised(line)) >= min_chars:
                places[n].append((d, i))
    names, met = sorted(places), defaultdict(list)
    for n in names:
        for choice in combinations(enumerate(line_blocks(n)), 4 - changed):
            met[choice].append(n)
    pairs = {p for group in met.values() for p in combinations(group, 2)}
    linked = []
    for a, b in pairs:
        if close(a, b, int((1 - similarity) * max(len(a), len(b)) + 1e-9)):
            linked.append((a, b))
    group, keep = components(names, linked), {}
    for n in names:
        keep[group[n]] = min(keep.get(group[n], (1 << 62, 0)), places[n][0])
    gone = {p for n in names for p in places[n] if p != keep[group[n]]}
    return {(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone)) for d, t in docs}


def runs(w, least=12):
    """Runs of w as stretches of equal letters at each distance; of one stretch the smallest distance."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, 2 * q):
                found.setdefault((start, i + q - start), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in found.items())


def planted(doc_id, text):
    w = WORD.findall((text or "").encode())
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def run_row(doc_id, text, least=12):
    w = planted(doc_id, text)
    found = runs(w, least)
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, digest(listed.encode()), digest(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def audit(docs, labels):
    """Filters applied one by one, document by document, under each order. docs: (doc_id, text, lang)."""
    from itertools import permutations

    words = [WORD.findall((t or "").encode()) for _, t, _ in docs]
    fails = []
    for (d, t, _), w in zip(docs, words, strict=True):
        t = t or ""
        why = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t)}
        why["E"] = d is not None and any((o or "") == t and e is not None and e < d for e, o, _ in docs)
        fails.append({k for k, v in why.items() if v})
    rows, shapley = {}, Counter()
    good, toxic = ({d for d, *marks in labels if d is not None and marks[k] == 1} for k in (0, 1))
    for order in permutations("ABCDE"):
        alive = [True] * len(docs)
        for step, f in enumerate(order, 1):
            for part in {p or "" for _, _, p in docs}:
                rows["".join(order), step, part] = Counter()
            for k, (d, _, part) in enumerate(docs):
                r = rows["".join(order), step, part or ""]
                if f in fails[k]:
                    r["removed" if alive[k] else "redundant"] += 1
                    r["unique_fails"] += fails[k] == {f}
                    if alive[k]:
                        r["good_lost"] += d in good
                        r["toxic_lost"] += d in toxic
                        shapley[f, part or ""] += 1
                        alive[k] = False
                r["kept"] += alive[k]
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(part, order, step, *[r[n] for n in names], shapley[order[step - 1], part]) for (order, step, part), r in rows.items()}


HEAD = r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""


def secrets(text):
    """(start, kind number, end, base) by the regular expressions, one after another."""
    text, found = text or "", {}
    for kind, pattern, base, keep in (
        (0, rf"(?i:{HEAD})([A-Za-z0-9+/_.=-]+)", True, lambda m: len(m[1]) >= 12),
        (1, "AKIA[A-Z0-9]+", True, lambda m: len(m[0]) >= 18),
        (2, "[0-9a-f]+", True, lambda m: len(m[0]) >= 16),
        (0, rf"(?i:{HEAD})[A-Za-z0-9+/_.=-]{{12,}}", False, bool),
        (3, r"-----BEGIN ([A-Z]+ )*PRIVATE KEY-----", False, bool),
        (4, "xox[abprs]-[A-Za-z0-9-]{10,}", False, bool),
    ):
        for m in re.finditer(pattern, text, re.ASCII):
            if keep(m):
                found[m.start(), kind, m.end()] = found.get((m.start(), kind, m.end()), False) or base
    return sorted((*k, b) for k, b in found.items())


def secret_row(doc_id, text):
    kinds, found = ("assign", "access", "hex", "pem", "slack"), secrets(text)
    said = lambda spans: ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e, _ in spans)
    base = [x for x in found if x[3]]
    return (doc_id, *[sum(x[1] == k for x in base) for k in range(3)], hashlib.sha256(said(base).encode()).hexdigest(), said(found))
