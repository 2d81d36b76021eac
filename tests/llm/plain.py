"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Sets:
    """Union by smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def fingerprint(text: str | None) -> int:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(docs: list[tuple[int, str | None]]) -> dict[int, tuple[str, int]]:
    fps = [fingerprint(t) for _, t in docs]
    sets = Sets(len(docs))
    order = sorted(range(len(docs)), key=lambda i: docs[i][0])
    place = {i: k for k, i in enumerate(order)}
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                sets.join(place[i], place[j])
    return {docs[i][0]: (f"{fps[i]:016x}", docs[order[sets.root(place[i])]][0]) for i in range(len(docs))}


def repeats(docs: list[tuple[int, str | None]], length: int = 50) -> list[tuple[int, bytes, int]]:
    """Of each document: id, what remains, and the number of removed runs."""
    first: dict[bytes, int] = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(d, first.get(w, d))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        runs = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((d, bytes(c for c, g in zip(b, gone, strict=True) if not g), runs))
    return out


def cosine_classes(vectors: dict[int, list[float]], threshold: float = 0.95) -> dict[int, tuple[int, int]]:
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    sets = Sets(len(ids))
    for a, b in zip(*np.nonzero(linked), strict=True):
        sets.join(int(a), int(b))
    return {i: (int(linked[k].sum()) - 1, ids[sets.root(k)]) for k, i in enumerate(ids)}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def letters_only(text: str) -> list[str]:
    """Words of a text for language identification: runs of word characters but digits and underscores, with a letter."""
    out, held = [], ""
    for c in [*text.lower(), " "]:
        if (c.isalnum() and not c.isdecimal()) and not re.fullmatch(r"[\d_]", c):
            held += c
        else:
            out += [held] if any(x.isalpha() for x in held) else []
            held = ""
    return out


def languages(rows: list[tuple[str | None, str | None, bool]]) -> list[tuple[str, float]]:
    """Prediction and score of each text (text, lang, learn)."""
    words: dict[str, dict[str, int]] = {}
    grams: list[dict[str, dict[str, int]]] = [{} for _ in range(6)]
    langs = set()
    for text, lang in {(t, l) for t, l, learn in rows if learn and t is not None and l is not None}:
        for w in letters_only(text):
            words.setdefault(w, {}).setdefault(lang, 0)
            words[w][lang] += 1
            for n in range(1, 6):
                m = w if n == 1 else f"<{w}>"
                for i in range(len(m) - n + 1):
                    own = grams[n].setdefault(m[i : i + n], {})
                    own[lang] = own.get(lang, 0) + 1
    tables = []
    for table in [words, *grams[1:]]:
        known = {k: v for k, v in table.items() if sum(v.values()) > 1}
        langs |= {l for v in known.values() for l in v}
        tables.append(known)
    names = sorted(langs)
    logs = []
    for known in tables:
        total = {l: sum(v.get(l, 0) + 0.5 for v in known.values()) for l in names}
        logs.append({k: [np.log((v.get(l, 0) + 0.5) / total[l]) for l in names] for k, v in known.items()})
    out = []
    for text, _, _ in rows:
        found = letters_only(text or "")
        if not found or not names:
            out.append(("und", 0.0))
            continue
        total = np.zeros(len(names))
        for w in found:
            if w in logs[0]:
                total += logs[0][w]
                continue
            for n in range(5, 0, -1):
                m = w if n == 1 else f"<{w}>"
                hits = [logs[n][m[i : i + n]] for i in range(len(m) - n + 1) if m[i : i + n] in logs[n]]
                if hits:
                    total += np.mean(hits, axis=0)
                    break
        p = np.exp(total - total.max())
        out.append((names[int(np.argmax(total))], float(p.max() / p.sum())))
    return out


def shingles(text: str | None, n: int = 5) -> frozenset[str]:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def near_copies(docs: list[tuple[int, str | None]], similarity: float = 0.8) -> dict[int, int]:
    """Of each document the smallest id reachable over pairs whose shingles have at least such a Jaccard similarity."""
    sets = [shingles(t) for _, t in docs]
    order = sorted(range(len(docs)), key=lambda i: docs[i][0])
    join, having = Sets(len(docs)), {}
    for k, i in enumerate(order):
        near = {j for s in sets[i] for j in having.get(s, ())} if sets[i] else {j for j in range(k) if not sets[order[j]]}
        for j in near:
            other = sets[order[j]]
            union = len(sets[i] | other)
            if not union or len(sets[i] & other) >= similarity * union - 1e-9:
                join.join(k, j)
        for s in sets[i]:
            having.setdefault(s, []).append(k)
    return {docs[i][0]: docs[order[join.root(k)]][0] for k, i in enumerate(order)}


def hinge(rows: list[list[int]], good: list[bool], cost: float, epochs: int, seed: int) -> tuple[dict[int, float], float, dict[int, float]]:
    """Weights, intercept and log-count ratios of a hinge-loss model over scaled indicators, feature by feature."""
    n = {k: {} for k in (True, False)}
    for r, g in zip(rows, good, strict=True):
        for f in r:
            n[g][f] = n[g].get(f, 0) + 1
    buckets = 1 << 20
    total = {k: sum(v.values()) + buckets for k, v in n.items()}
    ratio = {f: float(np.log((n[True].get(f, 0) + 1) / total[True]) - np.log((n[False].get(f, 0) + 1) / total[False])) if n[True].get(f, 0) + n[False].get(f, 0) >= 2 else 0.0 for r in rows for f in r}
    share = sum(good), len(good) - sum(good)
    limit = {True: cost, False: cost * float(np.sqrt(max(1, share[0]) / max(1, share[1])))}
    w, bias, dual, order = {}, 0.0, [0.0] * len(rows), np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            length = max(1e-12, float(np.sqrt(sum(ratio[f] ** 2 for f in rows[i]))))
            y = 1.0 if good[i] else -1.0
            margin = sum(w.get(f, 0.0) * ratio[f] / length for f in rows[i]) + bias
            new = min(max(dual[i] - (y * margin - 1) / 2, 0.0), limit[good[i]])
            step = (new - dual[i]) * y
            for f in rows[i] if step else ():
                w[f] = w.get(f, 0.0) + step * ratio[f] / length
            bias += step
            dual[i] = new
            worst = max(worst, abs(step))
        if worst < 1e-3:
            break
    return w, bias, ratio


def cheapest_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], epochs: int) -> tuple[int, int]:
    """The largest amount, and the least cost of any flow of that amount, by trying all of them."""
    best = {tuple(quotas): (0, 0)}  # what is left of the quotas: amount, cost
    for members, size in patterns:
        following: dict[tuple[int, ...], tuple[int, int]] = {}
        for left, (amount, cost) in best.items():
            tried = [(left, 0)]
            for s in members:
                tried = [(tuple(q - k if i == s else q for i, q in enumerate(l)), given + k) for l, given in tried for k in range(min(l[s], size * epochs - given) + 1)]
            for l, given in tried:
                own = sum(e * e * max(0, min(size, given - e * size)) for e in range(epochs))
                old = following.get(l)
                if old is None or (old[0], -old[1]) < (amount + given, -(cost + own)):
                    following[l] = amount + given, cost + own
        best = following
    return max(best.values(), key=lambda x: (x[0], -x[1]))
