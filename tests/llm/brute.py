"""Plain Python versions of the contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def joined(spans) -> str:  # noqa: ANN001
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii(text: str | None) -> tuple:
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    )
    found = []
    for k, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": k == 1 and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), k, m.end(), kind))
    n = Counter(s[3] for s in found)
    return tuple(n[k] for k, _ in kinds) + (sha(joined(found)),)


def secrets(text: str | None) -> tuple:
    t = text or ""
    found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    n = Counter(s[3] for s in found)
    return n["assign"], n["access"], n["hex"], sha(joined(found))


def bench_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def contaminated(docs: dict, items: dict) -> dict:
    windows = defaultdict(set)
    for item, text in items.items():
        w = bench_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[i : i + 10])].add(item)
    out = {}
    for d, text in docs.items():
        w, hit, owners = bench_words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if found := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    owners |= found
        out[d] = (len(w), len(hit), len(owners), sha(",".join(sorted(map(str, owners)))), bool(hit))
    return out


def repeats(docs: dict, size: int = 50) -> dict:
    words = {d: WORD.findall(t or "") for d, t in docs.items()}
    first: dict = {}
    for d in sorted(words):
        for i in range(len(words[d]) - size + 1):
            first.setdefault(tuple(words[d][i : i + size]), d)
    out = {}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < d:
                gone[i : i + size] = [True] * size
        out[d] = (len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def roots(ids, links):  # noqa: ANN001, ANN201
    parent = {i: i for i in ids}

    def find(x):  # noqa: ANN001, ANN202
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text: str | None) -> frozenset:
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(docs: dict) -> dict:
    sets = {d: shingles(t) for d, t in docs.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * (c := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - c)]
    root = roots(ids, links)
    return {d: (len(sets[d]), root[d], root[d] == d) for d in ids}


def lines(docs: dict, size: int = 7) -> dict:
    """(doc, text) to the text after fuzzy line dedup."""
    solid = lambda x: bool(x.strip(" \t\n\x0b\f\r"))
    first: dict = {}
    for d in sorted(docs):
        for k, x in enumerate((docs[d] or "").split("\n")):
            if solid(x):
                first.setdefault(x, (d, k))
    names = list(first)
    sets = [frozenset(x[i : i + size] for i in range(max(1, len(x) - size + 1))) for x in names]
    links = [(i, j) for i in range(len(names)) for j in range(i) if 100 * (c := len(sets[i] & sets[j])) >= 80 * (len(sets[i]) + len(sets[j]) - c)]
    root = roots(range(len(names)), links)
    head: dict = {}
    for k, x in enumerate(names):
        head[root[k]] = min(head.get(root[k], (1 << 62, 0)), first[x])
    at = {x: head[root[k]] for k, x in enumerate(names)}
    out = {}
    for d, text in docs.items():
        if text is None:
            out[d] = None
            continue
        cut = text.split("\n")
        out[d] = "\n".join(x for k, x in enumerate(cut) if not solid(x) or (at[x] == (d, cut.index(x)) and cut.index(x) == k))
    return out


def quality(text: str | None) -> tuple:
    t = text or ""
    w = WORD.findall(t)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    again = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if seen[x] > 1 for k in range(3)}
    full = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(again) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(full) - len(set(full)), len(again), failed


def merkle_root(nodes: list[str]) -> str:
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)]
    return nodes[0]


def merkle_way(nodes: list[str], at: int) -> list[tuple[int, list[str]]]:
    found = []
    while len(nodes) > 1:
        run = at // 16 * 16
        found.append((at % 16, [x for k, x in enumerate(nodes[run : run + 16]) if k != at % 16]))
        nodes, at = [sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)], at // 16
    return found


def merkle(rows: list[tuple]) -> list[tuple]:
    """rows: doc_id, source, lang, n_chars, text."""

    def leaf(values) -> str:  # noqa: ANN001
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = defaultdict(list)
    for r in rows:
        changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        groups[r[1]].append((r[0], leaf(r), leaf([*r[:4], r[4] and r[4].translate(LOWER)]) if changed else None))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in groups.values():
        g.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    tops = [merkle_root([x[1] for x in groups[g]]) for g in order]
    out = []
    for k, g in enumerate(order):
        for at, (doc, own, other) in enumerate(groups[g]):
            way = merkle_way([x[1] for x in groups[g]], at) + merkle_way(tops, k)
            now = other or own
            for place, others in way:
                now = sha("".join([*others[:place], now, *others[place:]]))
            root = merkle_root(tops)
            out.append((doc, own, tops[k], root, sha("".join(x for _, o in way for x in o)), now, now == root))
    return out


def vector_codes(rows: list[tuple]) -> list[tuple]:
    """rows: vec_id, vector, label; all in Python integers."""
    kept = [(i, [math.floor(4096 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 8
    parts = [[r[1][k * width : (k + 1) * width] for k in range(8)] for r in kept]
    books = [[p[k] for p in parts[:16]] for k in range(8)]

    def near(x: list, book: list) -> tuple:
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(6):
        for k, book in enumerate(books):
            of = defaultdict(list)
            for p in parts:
                of[near(p[k], book)[1]].append(p[k])
            books[k] = [[sum(c) // len(c) for c in zip(*of[e], strict=True)] if e in of else book[e] for e in range(len(book))]
    found = [[near(p[k], books[k]) for k in range(8)] for p in parts]
    total = Counter()
    for r, f in zip(kept, found, strict=True):
        total[r[2]] += sum(d for d, _ in f)
    digest = sha(",".join(str(x) for b in books for c in b for x in c))
    return [(r[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), total[r[2]], digest) for r, f in zip(kept, found, strict=True)]


def gram_counts(text: str) -> Counter:
    found = Counter()
    for word in re.findall(r"[^\W\d_]+", text):
        padded = f" {''.join(c.lower() if len(c.lower()) == 1 else c for c in word)} "
        for n in (1, 2, 3):
            found.update(padded[k : k + n] for k in range(len(padded) - n + 1) if padded[k : k + n] != " ")
    return found


def languages(learn: list[tuple], texts: list, size: int) -> list[tuple]:
    """learn: text, lang; ranks of n-grams by count, then by their characters, a shorter one's missing characters last."""
    counts = defaultdict(Counter)
    for text, lang in learn:
        if text is not None and lang is not None:
            counts[lang] += gram_counts(text)

    def ranked(c: Counter) -> list:
        return sorted(c, key=lambda g: (-c[g], [0 if x == " " else ord(x) for x in g] + [(1 << 21) - 1] * (3 - len(g))))[:size]

    known = {lang: {g: k for k, g in enumerate(ranked(c))} for lang, c in sorted(counts.items()) if c}
    out = []
    for text in texts:
        own = ranked(gram_counts(text or ""))
        if not own or not known:
            out.append(("und", 0.0))
            continue
        away = sorted((sum(abs(p[g] - k) if g in p else size for k, g in enumerate(own)), lang) for lang, p in known.items())
        rest = away[1][0] if len(away) > 1 else len(own) * size
        out.append((away[0][1], 1 - away[0][0] / rest if rest else 0.0))
    return out
