"""Plain, slow forms of the operators' definitions, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from itertools import combinations

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def shingles(text: str | None, size: int) -> set[tuple[str, ...]]:
    w = words(text)
    if not w:
        return set()
    size = min(size, len(w))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}


def near_components(docs: dict[int, str | None], size: int, percent: int) -> dict[int, tuple[int, int]]:
    """Set size and component of every id, by comparing all pairs."""
    sets = {i: shingles(t, size) for i, t in docs.items()}
    root = {i: i for i in docs}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    lists: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for x in s:
            lists.setdefault(x, []).append(i)
    for a, b in {p for ids in lists.values() for p in combinations(sorted(ids), 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in docs}


def luhn(digits: str) -> bool:
    double = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(double) + sum(map(int, digits[::-2]))) % 10 == 0


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def base_spans(text: str | None) -> list[tuple[int, str, int]]:
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((m.start(), k, m.end()))
    return [(a, PATTERNS[k][0], b) for a, k, b in sorted(out)]


def ppm_digits(text: str | None, training: list[str | None], order: int = 5, contexts: float = 1e9) -> float:
    """-log10 of a text and its end mark by escape method D with exclusions.

    Contexts of 3 bytes or more that hold less than 1 in ``contexts`` of the training bytes serve only
    inside units: words with the byte behind them, cut every 16 bytes.
    """
    from collections import Counter, defaultdict
    from math import log10

    counts: dict[tuple, Counter] = defaultdict(Counter)

    def marked(t):
        return [0xFE] * order + list((t or "").encode()) + [0xFF]

    for t in training:
        s = marked(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[tuple(s[i - k : i])][s[i]] += 1
    whole = sum(counts[()].values())

    def chance(context: tuple, symbol: int) -> float:
        p, excluded = 1.0, set()
        for k in range(len(context), -1, -1):
            seen = counts.get(context[len(context) - k :])
            if not seen:
                continue
            left = {x: n for x, n in seen.items() if x not in excluded}
            if not left:
                continue
            total = 2 * sum(left.values())
            if symbol in left:
                return p * (2 * left[symbol] - 1) / total
            p *= len(left) / total
            excluded |= set(seen)
        return p / (256 - len(excluded))

    def frequent(context: tuple) -> bool:
        held = sum(counts[context].values()) if context in counts else 0
        return held > 0 and (len(context) < 3 or held * contexts >= whole)

    s, out, place = marked(text), 0.0, None
    for i in range(order, len(s)):
        space = s[i - 1] in b" \t\n\x0b\x0c\r"
        if i == order or space:
            place = 0 if s[i] not in b" \t\n\x0b\x0c\r" and s[i] != 0xFF else None
        elif place is not None:
            place = (place + 1) % 16
        long = max(k for k in range(order + 1) if k == 0 or frequent(tuple(s[i - k : i])))
        if place is not None and long <= place:
            long = min(place, order)
        out -= log10(chance(tuple(s[i - long : i]), s[i]))
    return out


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def ranked(docs: list[tuple], items: list[tuple], k: int = 20) -> list[tuple]:
    """(item_id, rank, doc_id, score) of every item, by scoring every document."""
    held = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    held = [(i, tf, sum(tf.values())) for i, tf in held if tf]
    total, length = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, tf, _ in held for t in tf)
    out = []
    for item, text in items:
        asked, scores = TERM.findall((text or "").translate(LOWER)), []
        for i, tf, n in held:
            m = 75 + (25 * n * total) // length
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m))
                for t in asked if t in tf
            )
            if score > 0:
                scores.append((-score, i is not None, i or 0, i))
        scores.sort()
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(scores[:k])]
    return out


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text) -> str:
    parts = ("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text))
    return sha("".join(parts))


def folded_tree(nodes: list[str]) -> tuple[str, list[list[str]]]:
    """The root, and the siblings of every leaf level by level."""
    proofs, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for i in range(0, len(nodes) - 1, 2):
            for leaf in groups[i]:
                proofs[leaf].append(nodes[i + 1])
            for leaf in groups[i + 1]:
                proofs[leaf].append(nodes[i])
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        groups = [sum(groups[i : i + 2], []) for i in range(0, len(groups), 2)]
    return nodes[0], proofs


def manifest(rows: list[tuple]) -> dict[str, tuple]:
    """leaf -> (doc_id, subroot, root, siblings) of rows (doc_id, source, lang, n_chars, text)."""
    trees: dict = {}
    for r in rows:
        trees.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r[0]))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    roots = {lang: folded_tree([x[2] for x in sorted(trees[lang])]) for lang in langs}
    root, over = folded_tree([roots[lang][0] for lang in langs])
    out = {}
    for lang, above in zip(langs, over, strict=True):
        for (_, _, leaf, doc_id), proof in zip(sorted(trees[lang]), roots[lang][1], strict=True):
            out[leaf] = (doc_id, roots[lang][0], root, proof + above)
    return out
