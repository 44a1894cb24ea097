"""URL filters: wildcard rules as one bit-parallel automaton over canonical URLs.

All patterns lie side by side in 64-bit words, one bit for each state, and every character of a URL
moves all states of all patterns at once: ``D = ((D << 1) & B[c]) | (D & S[c])``. ``B[c]`` holds the
states that are entered by ``c``, ``S[c]`` those that a wildcard keeps alive.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Fixed values: (verdict, host, path). A rule fits its host and all subdomains.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Where no rule fits: names that unwanted hosts go by. A pattern without ``/`` is about the host alone.
GLOBS = [
    ("block", "*casino*"),
    ("block", "*adult*"),
    ("block", "*spam*"),
    ("block", "*-pills.*"),
    ("block", "*-bets.*"),
    ("block", "ads-*"),
    ("block", "*.ads-*"),
]
#: Bits unpacked at once when matches are read; bounds the temporary array.
STEP = 1 << 24
_FOUND = StructType([StructField(name, StringType()) for name in ("rule", "verdict", "pattern")])


class Automaton:
    """The first of ``patterns`` that matches each text as a whole.

    ``?`` stands for one character, ``*`` for any run of them. Before a pattern's first ``/``
    neither takes a ``/``, so that a host's wildcards stay in the host.
    """

    def __init__(self, patterns: Sequence[str]):
        parsed = [self._parse(p) for p in patterns]
        sizes = np.array([len(chars) + 1 for chars, _ in parsed], np.int64)
        first = np.cumsum(sizes) - sizes
        self.last = first + sizes - 1
        self.width = max(1, -(-int(sizes.sum()) // 64))
        known = sorted({ord(c) for chars, _ in parsed for c, _ in chars if c is not None} | {ord("/")})
        self.points = np.array(known)
        slash = known.index(ord("/")) + 1
        # Class 0 stands for every character that no pattern names.
        enter = np.zeros((len(known) + 1, self.width), np.uint64)
        stay = np.zeros_like(enter)
        classes = {chr(p): [i + 1] for i, p in enumerate(known)}
        every = list(range(len(known) + 1))
        host = [c for c in every if c != slash]

        def put(table: np.ndarray, which: list[int], bit: int) -> None:
            table[which, bit // 64] |= np.uint64(1 << bit % 64)

        self.start = np.zeros(self.width, np.uint64)
        for (chars, gaps), at in zip(parsed, first.tolist(), strict=True):
            self.start[at // 64] |= np.uint64(1 << at % 64)
            for i, (c, in_host) in enumerate(chars):
                put(enter, classes[c] if c is not None else host if in_host else every, at + i + 1)
            for state, in_host in gaps:
                put(stay, host if in_host else every, at + state)
        self.enter, self.stay = enter, stay

    @staticmethod
    def _parse(pattern: str) -> tuple[list[tuple[str | None, bool]], list[tuple[int, bool]]]:
        chars, gaps, in_host = [], [], True
        for c in pattern:
            in_host = in_host and c != "/"
            if c == "*":
                gaps.append((len(chars), in_host))
            else:
                chars.append((None if c == "?" else c, in_host))
        return chars, gaps

    def first(self, texts: Sequence[str]) -> np.ndarray:
        """The place of the first pattern that fits each text, -1 where none does."""
        sizes = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        raw = "".join([texts[i] for i in order]).encode("utf-32-le")
        points = np.frombuffer(raw, "<u4").astype(np.int64)
        place = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        classes = np.where(self.points[place] == points, place + 1, 0)
        begin = np.cumsum(sizes) - sizes
        states = np.tile(self.start, (len(texts), 1))
        # The texts are sorted, longest first: those that still have a character are a prefix.
        alive = len(texts) - np.searchsorted(sizes[::-1], np.arange(sizes[0] if len(sizes) else 0), "right")
        for j, n in enumerate(alive.tolist()):
            c = classes[begin[:n] + j]
            now = states[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            states[:n] = (moved & self.enter[c]) | (now & self.stay[c])
        out = np.full(len(texts), -1, np.int64)
        rows = max(1, STEP // (64 * self.width))
        for a in range(0, len(texts), rows) if len(self.last) else ():
            part = states[a : a + rows]
            hit = (part[:, self.last // 64] >> (self.last % 64).astype(np.uint64)) & np.uint64(1)
            out[order[a : a + rows]] = np.where(hit.any(axis=1), hit.argmax(axis=1), -1)
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty if it is null or has no ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lower, path


def compiled(
    rules: Sequence[tuple[str, str, str]], globs: Sequence[tuple[str, str]]
) -> list[tuple[str, str | None, str, str]]:
    """``(pattern, rule, verdict, text)``, the one that wins first.

    Every rule comes before every glob; the longer text wins, then the verdict ``block``.
    """
    wins = lambda r: (-len(r[-1]), r[-2] != "block", r[-1])
    ruled = sorted(((verdict, f"{host}{path}") for verdict, host, path in rules), key=wins)
    loose = sorted(globs, key=wins)
    escaped = [t for _, t in ruled if "*" in t or "?" in t]
    if escaped:
        raise ValueError(f"rules hold no wildcards: {escaped}")
    out = [(f"{lead}{t}*", t, verdict, t) for verdict, t in ruled for lead in ("", "*.")]
    for verdict, t in loose:
        out += [(p, None, verdict, t) for p in ([t] if "/" in t else [t, f"{t}/*"])]
    return out


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    globs: Sequence[tuple[str, str]] = GLOBS,
    default: str = "allow",
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, pattern)`` for every row of ``pages``.

    The longest rule that fits decides; else the longest of ``globs``, wildcard patterns over host
    and path; else ``default``. ``rule`` is the rule's text, null if none fits; ``pattern`` the text
    of what decided, null for the default. A null URL, or one without ``://``, has an empty host
    and path, so only a pattern of wildcards fits it. Query and fragment are not looked at.
    Repeated rows are judged each; other columns are ignored. Each task judges its own rows, with
    a table of (characters named by patterns + 1) x (states / 64) words: it grows with the rules alone.
    """
    table = compiled(rules, globs)
    automaton = Automaton([row[0] for row in table])
    found = [row[1:] for row in table] + [(None, default, None)]

    @F.pandas_udf(_FOUND)
    def decide(canonical: pd.Series) -> pd.DataFrame:
        rows = [found[i] for i in automaton.first(canonical.tolist())]
        return pd.DataFrame(rows, columns=["rule", "verdict", "pattern"], dtype=object)

    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    judged = parts.withColumn("found", decide(F.concat("host", "path")))
    return judged.select("page_id", "host", "path", "found.rule", "found.verdict", "found.pattern")
