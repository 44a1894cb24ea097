"""Personal data: exact patterns for four kinds, and more found by bootstrapping from context.

One pass over the texts finds the base spans (the contract's patterns) and weaker candidates that
look alike but miss them: obfuscated addresses, numbers without a plus sign, card-length numbers
in longer runs. Every occurrence carries lexical patterns: the words next to it. Spark then
scores the graph of patterns and values in rounds. A pattern's confidence is the share of its
distinct values that are known; a confident pattern that enough known values support makes its
other values known, which raises more patterns. Candidates whose value is known in the end become
spans too; base spans always stay.

What a confident pattern stands beside may have any shape: every run of digits with separators, and of
words with "at" and "dot", that is loosely of a kind is kept with its patterns. As most such runs are
something else, only patterns that are confident with all of them counted extract loose ones.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.pieces import slices
from earshot.session import cut

KINDS = ("email", "ip", "card", "phone")
#: A pattern counts from so many known values and this share of them among its values.
SUPPORT, CONFIDENCE = 5, 0.9
#: Rounds go on until one finds nothing; so many mean that something is wrong.
MAX_ROUNDS = 1_000
#: Characters before and after an occurrence in which its words are looked for.
NEAR = 60
SLICE = 8_000_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Every match of the numeric kinds lies within one zone.
_ZONE = re.compile(r"[+0-9][0-9 .()\-]*")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Candidates.
_AT = re.compile(
    r"\b([A-Za-z0-9][A-Za-z0-9._%+-]{0,63}) ?(?:\[at\]|\(at\)|\{at\}) ?([A-Za-z0-9-]{1,63})"
    r"((?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z0-9-]{1,63}){1,4})"
)
_DOTS = re.compile(r" ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?")
_DEFANGED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])")
_DIGITS = re.compile(r"(?<![0-9])[0-9]{14,19}(?![0-9])")
_CALL = re.compile(r"(?<![0-9+])(?:00[1-9][0-9 ().-]{7,17}[0-9]|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])")

# Loose shapes.
_AT_SIGN = re.compile(r"[\[({<]\s?(?:[aA][tT]|@)\s?[\])}>]|(?<=\s)(?:[aA][tT]|@)(?=\s)|_[aA][tT]_")
_GAP = re.compile(r"\s{0,2}")
_NAME = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?=\s{0,2}\Z)")
_DOT = r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\s{1,2}dot\s{1,2}|_dot_|\.)"
_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,4}}", re.I)
_QUAD = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:(?:{_DOT}|\s?\.\s?)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_ANY_DOT = re.compile(rf"{_DOT}|\s?\.\s?", re.I)
_RUN = re.compile(r"(?<!\w)[+(]{0,2}[0-9](?:[ ()./\u00a0\u2010-\u2013-]{0,3}[0-9])++")
_NUMBER = re.compile(r"[0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    over, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > over and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            over = m.end()
            yield start, over
        at = text.find("@", max(at + 1, over))


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every base span, in order of start and kind."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for zone in _ZONE.finditer(text):
        a, b = zone.span()
        if b - a < 7:
            continue
        out += [
            (*m.span()[:1], 1, m.end()) for m in _IP.finditer(text, a, b)
            if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
        ]
        for m in _CARD.finditer(text, a, b):
            digits = _only_digits(m[0]) if m.end() - m.start() < 40 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text, a, b):
            if 10 <= len(_only_digits(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return [(a, KINDS[k], b) for a, k, b in out]


def value_of(kind: str, found: str) -> str:
    """What makes two occurrences the same identifier."""
    if kind == "email":
        m = _AT.fullmatch(found)
        return (f"{m[1]}@{m[2]}{_DOTS.sub('.', m[3])}" if m else found).lower()
    if kind == "ip":
        return found.replace("[.]", ".")
    digits = _only_digits(found)
    return digits.removeprefix("00") if kind == "phone" else digits


def candidate_spans(text: str, base: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Spans that look like a kind without being one of its base spans, none over a base span."""
    out = []
    if "at" in text and ("[" in text or "(" in text or "{" in text):
        out += [(m.start(), "email", m.end()) for m in _AT.finditer(text)]
    if "[.]" in text:
        out += [
            (m.start(), "ip", m.end()) for m in _DEFANGED.finditer(text)
            if all(int(p) <= 255 for p in m[0].split("[.]"))
        ]
    for zone in _ZONE.finditer(text):
        a, b = zone.span()
        a -= text[a - 1 : a] == "("  # a zone begins with a digit
        if b - a >= 10:
            out += [(m.start(), "card", m.end()) for m in _DIGITS.finditer(text, a, b)]
            out += [(m.start(), "phone", m.end()) for m in _CALL.finditer(text, a, b)]
    taken = [(a, b) for a, _, b in base]
    return sorted(s for s in out if not any(a < s[2] and s[0] < b for a, b in taken))


def contexts(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a span: one and two words before it, one after it."""
    before = text[max(0, start - NEAR) : start].lower().split()[-2:]
    after = text[end : end + NEAR].lower().split()[:1]
    out = [f"before {before[-1]}"] if before else []
    out += [f"before {' '.join(before)}"] if len(before) > 1 else []
    return out + [f"after {w}" for w in after]


def _ends(text: str, run: tuple[int, int], span: tuple[int, int]) -> list[str]:
    """The patterns of a number run for a part of it: those of the ends that it is near to."""
    out = []
    for pattern in contexts(text, *run):
        near = span[0] - run[0] if pattern.startswith("before") else run[1] - span[1]
        out += [pattern] if near <= NEAR else []
    return out


def _cards(text: str, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Parts of a run of numbers that may be cards: by check digit, else the run if it fits."""
    first, last, found = parts[0][0], parts[-1][1], []
    for i, (a, _) in enumerate(parts):
        if a - first > NEAR and last - a > 2 * NEAR + 20:
            continue
        for _, b in parts[i : i + 19]:
            size = len(_only_digits(text[a:b]))
            if size > 19:
                break
            if size >= 14 and (a - first <= NEAR or last - b <= NEAR) and luhn(_only_digits(text[a:b])):
                fours = re.fullmatch(r"[0-9]{4}(?:[^0-9]+[0-9]{4}){3}", text[a:b])
                found.append((not fours, a, -b))
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(found):
        if all(-b <= c or d <= a for c, d in out):
            out.append((a, -b))
    if not out and 14 <= len(_only_digits(text[first:last])) <= 19:
        out.append((first, last))
    return out


def _phones(text: str, parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The run of numbers if it fits a phone, else what fits at its start and at its end."""
    sizes = [b - a for a, b in parts]
    if sum(sizes) <= 15:
        return [(parts[0][0], parts[-1][1])] if sum(sizes) >= 7 else []
    out, n, size = [], 0, 0
    while size + sizes[n] <= 15:
        size, n = size + sizes[n], n + 1
    out += [(parts[0][0], parts[n - 1][1])] if size >= 7 else []
    n, size = len(sizes), 0
    while size + sizes[n - 1] <= 15:
        size, n = size + sizes[n - 1], n - 1
    return out + ([(parts[n][0], parts[-1][1])] if size >= 7 else [])


def _taken(spans: list[tuple[int, str, int]]) -> tuple[list[int], list[int]]:
    """Starts of the spans in order, and the last stop of those up to each."""
    spans = sorted(spans)
    return [a for a, _, _ in spans], list(accumulate((b for _, _, b in spans), max))


def _meets(taken: tuple[list[int], list[int]], a: int, b: int) -> bool:
    n = bisect_left(taken[0], b)
    return n > 0 and taken[1][n - 1] > a


def loose_spans(
    text: str, base: list[tuple[int, str, int]], likely: list[tuple[int, str, int]]
) -> list[dict]:
    """Occurrences of loose shape, none over a base span or a candidate of its kind.

    A part of a number run is beside the words around the whole run.
    """
    out: list[tuple[str, int, int, str, list[str]]] = []
    for m in _AT_SIGN.finditer(text):
        host = _HOST.match(text, _GAP.match(text, m.end()).end())
        name = _NAME.search(text, max(0, m.start() - 67), m.start()) if host else None
        if name:
            value = f"{name[0]}@{_ANY_DOT.sub('.', host[0])}".lower()
            a, b = name.start(), host.end()
            out.append(("email", a, b, value, contexts(text, a, b)))
    for m in _QUAD.finditer(text):
        value = _ANY_DOT.sub(".", m[0])
        if all(int(p) <= 255 for p in value.split(".")):
            out.append(("ip", *m.span(), value, contexts(text, *m.span())))
    for m in _RUN.finditer(text):
        if m.end() - m.start() < 7:
            continue
        parts = [n.span() for n in _NUMBER.finditer(text, *m.span())]
        if text[m.end() : m.end() + 1].isalpha() or text[m.end() : m.end() + 1] == "_":
            parts.pop()
        if not parts:
            continue
        lead = m.start() if text[m.start()] in "+(" else parts[0][0]
        run = lead, parts[-1][1]
        for kind, pick in (("card", _cards), ("phone", _phones)):
            for a, b in pick(text, parts):
                a = lead if kind == "phone" and a == parts[0][0] else a
                out.append((kind, a, b, value_of(kind, text[a:b]), _ends(text, run, (a, b))))
    taken = {k: _taken(base + [c for c in likely if c[1] == k]) for k in KINDS}
    return [
        {"kind": k, "start": a, "stop": b, "value": v, "patterns": p}
        for k, a, b, v, p in out
        if not _meets(taken[k], a, b)
    ]


_OCCURRENCE = "struct<kind:string,start:int,stop:int,value:string,patterns:array<string>>"


def occurrences(docs: DataFrame) -> DataFrame:
    """``(doc_id, mark, base, likely, loose)`` per row: spans of the whole text, from exact to loose.

    ``mark`` is a hash of the text that tells rows with a repeated id apart.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, mark bigint, base array<{_OCCURRENCE}>, likely array<{_OCCURRENCE}>, "
    schema += f"loose array<{_OCCURRENCE}>"
    items = pa.list_(pa.struct([
        ("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()),
        ("value", pa.string()), ("patterns", pa.list_(pa.string())),
    ]))

    def describe(text: str, spans: list[tuple[int, str, int]]) -> list[dict]:
        return [
            {"kind": k, "start": a, "stop": b, "value": value_of(k, text[a:b]),
             "patterns": contexts(text, a, b)}
            for a, k, b in spans
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.utf8_length(batch["text"]).to_pylist()
            for a, b in slices(sizes, SLICE):
                part, base, likely, loose = batch.slice(a, b - a), [], [], []
                for text in part["text"].to_pylist():
                    spans = base_spans(text)
                    base.append(describe(text, spans))
                    more = candidate_spans(text, spans)
                    likely.append(describe(text, more))
                    loose.append(loose_spans(text, spans, more))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], part["mark"], *(pa.array(x, items) for x in (base, likely, loose))],
                    ["doc_id", "mark", "base", "likely", "loose"],
                )

    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("mark"), text.alias("text"))
    return rows.mapInArrow(run, schema)


def bootstrap(
    seen: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE
) -> DataFrame:
    """``(kind, value)`` of candidates that confident patterns, or base spans elsewhere, vouch for.

    A pattern vouches for candidates by its share of known values among those of base spans,
    candidates and runs found so far; for loose runs, among all. Known values only grow, so the rounds end.
    """

    def edges(column: str) -> DataFrame:
        spans = seen.select(F.explode(column).alias("s"))
        return spans.select("s.kind", "s.value", F.explode_outer("s.patterns").alias("pattern"))

    def level(column: str, seed: int, sure: int) -> DataFrame:
        return edges(column).select("*", F.lit(seed).alias("seed"), F.lit(sure).alias("sure"))

    graph = level("base", 1, 1).unionByName(level("likely", 0, 1)).unionByName(level("loose", 0, 0))
    graph = cut(
        graph.groupBy("kind", "value", "pattern").agg(F.max("seed").alias("seed"), F.max("sure").alias("sure"))
    )
    values = graph.groupBy("kind", "value").agg(F.max("seed").alias("known"))
    values = cut(values)
    for _ in range(MAX_ROUNDS):
        marked = graph.join(values, ["kind", "value"])
        trusted = (
            marked.where("pattern IS NOT NULL").groupBy("kind", "pattern")
            .agg(F.sum("known").alias("k"), F.sum(F.greatest("known", "sure")).alias("n"), F.count(F.lit(1)).alias("all"))
            .where((F.col("k") >= support) & (F.col("k") >= confidence * F.col("n")) & (F.col("k") < F.col("all")))
            .select("kind", "pattern", (F.col("k") >= confidence * F.col("all")).alias("extracts"))
        )
        more = marked.where("known = 0").join(trusted, ["kind", "pattern"]).where("sure = 1 OR extracts")
        more = cut(more.select("kind", "value", F.lit(1).alias("known")).distinct())
        if more.isEmpty():
            break
        values = cut(
            values.unionByName(more).groupBy("kind", "value").agg(F.max("known").alias("known"))
        )
    else:
        raise RuntimeError("bootstrapping did not settle")
    return values.where("known = 1").select("kind", "value")


def find_private(docs: DataFrame) -> DataFrame:
    """``(doc_id, base, spans)`` per row of ``docs``: base spans, and all spans.

    Spans are arrays of ``(start, kind, stop)`` in code points, by start and then kind in the order
    of ``KINDS``. A null text is empty and has none. Rows that repeat an id are told apart by their
    text; other columns are not read.
    """
    seen = cut(occurrences(docs))
    known = bootstrap(seen)
    likely = seen.select("doc_id", "mark", F.explode(F.concat("likely", "loose")).alias("s")).select(
        "doc_id", "mark", "s.kind", "s.value", "s.start", "s.stop"
    )
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    found = likely.join(known, ["kind", "value"]).select(
        "doc_id", "mark", F.struct("start", rank.alias("rank"), "kind", "stop").alias("span")
    )
    # A text's own finds, as many as it has.
    added = found.distinct().groupBy("doc_id", "mark").agg(F.collect_list("span").alias("more"))
    no_id, an_id = F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id")
    base = F.transform("base", lambda s: F.struct(
        s["start"].alias("start"),
        F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).cast("int").alias("rank"),
        s["kind"].alias("kind"), s["stop"].alias("stop"),
    ))
    rows = seen.select("doc_id", no_id, an_id, "mark", base.alias("base"))
    added = added.select(no_id, an_id, "mark", "more")
    both = F.when(F.col("more").isNull(), F.col("base")).otherwise(
        F.array_sort(F.concat("base", "more"))
    )
    return rows.join(added, ["_none", "_id", "mark"], "left").select(
        "doc_id", "base", both.alias("spans")
    )


def span_text(column: str):
    """Spans as ``kind:start:end``, comma-joined."""
    return F.array_join(
        F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))),
        ",",
    )
