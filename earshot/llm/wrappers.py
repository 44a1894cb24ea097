"""Main text of web pages by inferring wrappers of their hosts.

A page is a stream of tags and texts. A host's wrapper is a union-free regular expression over
such streams: tags, text slots, optional groups and repeated groups. It comes from all pages of the
host: equal streams are added up, then the distinct ones are aligned in turn, in groups first.
Runs that repeat are folded to repeated groups before; equal tags are matched; what only one side has
becomes an optional group; texts in the same place become a slot.

The wrapper says what each slot is: part of the article, or of the frame around it. Slots in
menus, headers, footers, forms and the like are frame, by the tags and class names that enclose
them; so is a repeated group of links. A text that most pages of the host have in such a place is
frame too, inside the article as well. Every page's stream is then matched with its host's wrapper,
and the texts in article slots are its main text; text the wrapper has never seen is judged by
what encloses it.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher
from hashlib import blake2b
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.session import cut

#: Groups that a host's distinct streams are dealt over before the last merge.
SALTS = 64
#: A text is the host's, not the page's, if so many of its distinct pages have it, and most of them.
SHARED = 3
#: Folded tokens that are aligned at once; longer streams are cut at anchors first.
LONGEST = 4_000
#: Tokens in a run that may be an anchor, the longest first.
RUNS = (32, 8, 3, 1)
#: Tables of up to so many hosts (wrappers of a few hundred bytes) are broadcast; larger ones are
#: joined by a shuffle, whose busy hosts adaptive execution splits.
HOSTS = 10_000

# HTML element names by role.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
HOLDERS = frozenset(
    "article aside blockquote body button dialog div dl fieldset figure footer form head header "
    "main menu nav noscript ol section select table td tr ul a".split()
)
FRAME = frozenset(
    "aside button dialog fieldset footer form head header menu nav noscript select".split()
)
RAW = frozenset("iframe noembed noframes script style svg template textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
ARTICLE = frozenset(["article", "main"])
FRAME_NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer header menu modal nav navbar navigation newsletter notice notices "
    "pagination popup promo related respond share sharing sidebar social sponsor sponsored "
    "subscribe toolbar widget".split()
)

_TOKEN = re.compile(  # possessive: no step back, so broken markup costs no more than sound markup
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|"
    r"<(/?)([A-Za-z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[^A-Za-z0-9]+")


@dataclass
class Text:
    """One block of text, and what encloses it."""

    value: str
    framed: bool
    in_article: bool
    in_link: bool


@dataclass
class Page:
    """A page's stream: ``tokens`` has tags, and ``#`` for a text; ``texts`` has those."""

    tokens: list[str] = field(default_factory=list)
    texts: list[Text] = field(default_factory=list)
    places: list[int] = field(default_factory=list)


def _frame(tag: str, attributes: str) -> bool:
    if tag in FRAME:
        return True
    if "=" not in attributes:
        return False
    words = (w.lower() for m in _NAMES.finditer(attributes) for w in _PART.split(m[1] or m[2] or m[3] or ""))
    return any(w in FRAME_NAMES for w in words)


def parse(html: str) -> Page:
    """Tags and text blocks of a page, in order."""
    page, parts = Page(), []
    stack: list[tuple[str, bool]] = []
    opened: Counter[str] = Counter()
    articles = links = frames = linked = 0
    size = 0

    def flush() -> None:
        nonlocal linked, size
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            page.places.append(len(page.tokens))
            page.tokens.append("#")
            page.texts.append(Text(text, frames > 0, articles > 0, linked * 2 > size))
        linked = size = 0

    at, end = 0, len(html)
    raw = ""
    while at < end:
        m = _TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            piece = unescape(html[at:stop])
            parts.append(piece)
            size += len(piece)
            linked += len(piece) if links else 0
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if tag in RAW and not closing:
            over = re.compile(f"</{re.escape(tag)}\\s*>", re.I).search(html, at)
            at = over.end() if over else end
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCKS:
            flush()
        if closing:
            if opened[tag]:
                flush()
                while stack:
                    t, framed = stack.pop()
                    opened[t] -= 1
                    frames -= framed
                    articles -= t in ARTICLE
                    links -= t == "a"
                    if t == tag:
                        break
            page.tokens.append(f"/{tag}")
        else:
            if tag in HOLDERS and not m[3].rstrip().endswith("/"):
                framed = _frame(tag, m[3]) and tag not in ("body", "a")
                if framed:
                    flush()
                stack.append((tag, framed))
                opened[tag] += 1
                frames += framed
                articles += tag in ARTICLE
                links += tag == "a"
            if tag not in VOID:
                page.tokens.append(tag)
    flush()
    return page


def groups(page: Page) -> tuple[list[str], list[list[int]]]:
    """The folded stream, and for each of its places the numbers of the texts that fall there."""
    place_of: dict[int, int] = {p: i for i, p in enumerate(page.places)}
    tokens: list[str] = []
    texts: list[list[int]] = []
    for i, token in enumerate(page.tokens):
        tokens.append(token)
        texts.append([place_of[i]] if i in place_of else [])
        for n in (1, 2, 3, 4, 5, 6):
            if len(tokens) >= 2 * n and tokens[-n:] == tokens[-2 * n : -n]:
                for k in range(n):
                    texts[-2 * n + k] += texts[-n + k]
                del tokens[-n:], texts[-n:]
                break
    return tokens, texts


@dataclass
class Slot:
    """A place of the wrapper. ``kind``: the token; text slots know what has enclosed their texts."""

    kind: str
    seen: int = 0
    framed: int = 0
    article: int = 0
    links: int = 0
    held: int = 0

    def add(self, other: Slot) -> None:
        for name in COUNTED:
            setattr(self, name, getattr(self, name) + getattr(other, name))


COUNTED = ("seen", "framed", "article", "links", "held")


def stream_of(page: Page) -> list[Slot]:
    """A page's folded stream as a wrapper of this page alone."""
    out = []
    for token, numbers in zip(*groups(page), strict=True):
        texts = [page.texts[n] for n in numbers]
        out.append(
            Slot(token, 1, sum(t.framed for t in texts), sum(t.in_article for t in texts),
                 sum(t.in_link for t in texts), len(texts))
        )
    return out


def text_keys(page: Page) -> list[int]:
    """For each text a hash of it and of where it stands: the tag before it, in the article or not."""
    out = []
    for place, t in zip(page.places, page.texts, strict=True):
        where = f"{page.tokens[place - 1] if place else ''} {t.in_article and not t.framed:d} {t.value}"
        digest = blake2b(where.encode("utf-8", "surrogatepass"), digest_size=8).digest()
        out.append(int.from_bytes(digest, "little", signed=True))
    return out


def _anchors(a: list[str], b: list[str], low: tuple[int, int], high: tuple[int, int]) -> list[tuple[int, int]]:
    """Places of runs that either side has once, rising on both sides."""

    def once(tokens: list[str], first: int, last: int, n: int) -> dict[tuple[str, ...], int]:
        at: dict[tuple[str, ...], int] = {}
        for i in range(first, last - n + 1):
            key = tuple(tokens[i : i + n])
            at[key] = -1 if key in at else i
        return {k: i for k, i in at.items() if i >= 0}

    for n in RUNS:
        left, right = once(a, low[0], high[0], n), once(b, low[1], high[1], n)
        pairs = sorted((i, right[k]) for k, i in left.items() if k in right)
        # The longest rising sequence.
        tails: list[int] = []
        best: list[int] = []
        before = [-1] * len(pairs)
        for p, (_, j) in enumerate(pairs):
            at = bisect_left(tails, j)
            before[p] = best[at - 1] if at else -1
            tails[at : at + 1] = [j]
            best[at : at + 1] = [p]
        if best:
            out, p = [], best[-1]
            while p >= 0:
                out.append(pairs[p])
                p = before[p]
            return out[::-1]
    return []


def matches(a: list[str], b: list[str]) -> list[tuple[int, int, int]]:
    """Matching blocks ``(i, j, n)`` of two streams of any length, in order.

    Long streams are cut at runs of tokens that both have once; where there are none, both are
    halved.
    """
    out: list[tuple[int, int, int]] = []
    todo = [((0, 0), (len(a), len(b)))]
    while todo:
        (i, j), (k, m) = todo.pop()
        if k - i <= LONGEST and m - j <= LONGEST:
            match = SequenceMatcher(None, a[i:k], b[j:m], autojunk=False)
            out += [(i + x, j + y, n) for x, y, n in match.get_matching_blocks() if n]
            continue
        same = 0
        while i + same < k and j + same < m and a[i + same] == b[j + same]:
            same += 1
        if same:
            out.append((i, j, same))
            todo.append(((i + same, j + same), (k, m)))
            continue
        if i == k or j == m:
            continue
        while same < min(k - i, m - j) and a[k - 1 - same] == b[m - 1 - same]:
            same += 1
        if same:
            out.append((k - same, m - same, same))
            todo.append(((i, j), (k - same, m - same)))
            continue
        cuts = _anchors(a, b, (i, j), (k, m)) or [((i + k) // 2, (j + m) // 2)]
        if cuts == [(i, j)]:
            cuts = [((i + k) // 2, (j + m) // 2)]
        ends = [(i, j), *cuts, (k, m)]
        todo += [(x, y) for x, y in zip(ends, ends[1:]) if x[0] < y[0] and x[1] < y[1]]
    return sorted(out)


def infer(streams: list[list[Slot]]) -> list[Slot]:
    """A wrapper that matches all the streams, or wrappers: optional places are not ``seen`` on all pages."""
    wrapper: list[Slot] = []
    for stream in streams:
        merged: list[Slot] = []
        a = c = 0
        blocks = matches([s.kind for s in wrapper], [s.kind for s in stream])
        for i, j, n in [*blocks, (len(wrapper), len(stream), 0)]:
            merged += wrapper[a:i] + stream[c:j]
            a, c = i + n, j + n
            for slot, other in zip(wrapper[i:a], stream[j:c], strict=True):
                slot.add(other)
                merged.append(slot)
        wrapper = merged
    return wrapper


def roles(wrapper: list[Slot]) -> str:
    """One letter per place: m main text, f frame, . no text."""
    has_article = any(s.article and s.framed < s.held for s in wrapper)
    out = []
    for s in wrapper:
        if s.kind != "#":
            out.append(".")
        elif s.framed * 2 >= s.held:
            out.append("f")
        elif has_article:
            out.append("m" if s.article * 2 >= s.held else "f")
        else:
            out.append("f" if s.links * 2 > s.held else "m")
    return "".join(out)


def _described(wrapper: list[Slot], pages: int, common: list[int]) -> str:
    return json.dumps(
        {
            "places": [s.kind for s in wrapper],
            "roles": roles(wrapper),
            "optional": [i for i, s in enumerate(wrapper) if s.seen < pages],
            "common": sorted(common),
        }
    )


def wrapper_of(pages: list[str]) -> str:
    """The wrapper of a host as JSON: its places, their roles, and the keys of texts that are the host's."""
    parsed = [parse(p) for p in pages]
    counts = Counter(k for p in {h: p for h, p in zip(pages, parsed, strict=True)}.values() for k in set(text_keys(p)))
    common = [k for k, n in counts.items() if n >= SHARED and n * 2 > len(set(pages))]
    return _described(infer([stream_of(p) for p in parsed]), len(parsed), common)


def extract(html: str, wrapper: dict | None) -> str:
    """The main text of a page: its article blocks joined by line ends."""
    page = parse(html)
    tokens, texts = groups(page)
    own = any(t.in_article and not t.framed for t in page.texts)
    plain = [not t.framed and (t.in_article or not own) and not (t.in_link and not own) for t in page.texts]
    keep = list(plain)
    if wrapper:
        for a, b, n in matches(wrapper["places"], tokens):
            for k in range(n):
                role = wrapper["roles"][a + k]
                for number in texts[b + k]:
                    t = page.texts[number]
                    # What encloses the text itself overrules what the slot holds elsewhere.
                    if role == "m" and not t.framed and (t.in_article or not own):
                        keep[number] = True
                    elif role == "f" and not (own and t.in_article and not t.framed):
                        keep[number] = False
        common = set(wrapper.get("common", ()))
        if common:  # also inside articles
            keep = [k and key not in common for k, key in zip(keep, text_keys(page), strict=True)]
    if not any(keep):  # a page unlike its host's others
        keep = plain
    return "\n".join(t.value for t, k in zip(page.texts, keep, strict=True) if k)


def _host(url: str):
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))
    return host


def _small(per_host: DataFrame) -> DataFrame:
    """The table, marked for broadcast if it has at most ``HOSTS`` rows."""
    return F.broadcast(per_host) if per_host.count() <= HOSTS else per_host


def _streams(rows: DataFrame) -> DataFrame:
    """``(host, page, texts, stream, counts)``: a page's text keys, or how often a task has met a stream.

    ``counts`` has the numbers of ``COUNTED`` one after the other, each over the stream's places.
    """
    schema = "host string, page bigint, texts array<bigint>, stream string, counts array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, marks, keys = [], [], []
            met: dict[tuple[str, str], list[int]] = {}
            for host, mark, html in zip(*(batch[c].to_pylist() for c in ("host", "page", "html")), strict=True):
                page = parse(html)
                hosts.append(host)
                marks.append(mark)
                keys.append(list(set(text_keys(page))))
                slots = stream_of(page)
                numbers = [getattr(s, name) for name in COUNTED for s in slots]
                key = host, " ".join(s.kind for s in slots)
                met[key] = [x + y for x, y in zip(met[key], numbers, strict=True)] if key in met else numbers
            n = len(met)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hosts + [h for h, _ in met], pa.string()),
                    pa.array(marks + [None] * n, pa.int64()),
                    pa.array(keys + [None] * n, pa.list_(pa.int64())),
                    pa.array([None] * len(hosts) + [s for _, s in met], pa.string()),
                    pa.array([None] * len(hosts) + list(met.values()), pa.list_(pa.int64())),
                ],
                ["host", "page", "texts", "stream", "counts"],
            )

    return rows.mapInArrow(run, schema)


def _slots_of(stream: str, counts: list[int]) -> list[Slot]:
    kinds = stream.split(" ") if stream else []
    n = len(kinds)
    return [Slot(k, *(int(counts[i + n * c]) for c in range(len(COUNTED)))) for i, k in enumerate(kinds)]


def _merge(group: pd.DataFrame) -> list[Slot]:
    """One wrapper of all rows: equal streams are added up, the others aligned, the commonest first."""
    sums: dict[str, list[int]] = {}
    for stream, counts in zip(group["stream"], group["counts"], strict=True):
        sums[stream] = [x + y for x, y in zip(sums[stream], counts, strict=True)] if stream in sums else list(counts)
    order = sorted(sums, key=lambda s: (-max(sums[s][: s.count(" ") + 1], default=0), s))
    return infer([_slots_of(s, sums[s]) for s in order])


def host_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, wrapper)`` from all pages of each host."""
    rows = pages.select(_host("url").alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.where("html <> ''").select("host", F.xxhash64("html").alias("page"), "html")
    met = cut(_streams(rows))
    # A page that repeats counts once among those that share a text.
    distinct = met.where("page IS NOT NULL").select("host", "page", "texts").dropDuplicates(["host", "page"])
    distinct = cut(distinct)
    n = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    shared = (
        distinct.select("host", F.explode("texts").alias("key")).groupBy("host", "key")
        .agg(F.count(F.lit(1)).alias("with")).where(F.col("with") >= SHARED)
    )
    common = shared.join(n, "host").where(F.col("with") * 2 > F.col("n"))
    common = common.groupBy("host").agg(F.collect_list("key").alias("common"))

    def part(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        slots = _merge(group)
        counts = [getattr(s, name) for name in COUNTED for s in slots]
        return pd.DataFrame([[key[0], " ".join(s.kind for s in slots), counts]], columns=["host", "stream", "counts"])

    def learn(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        found = group["common"].iloc[0]
        described = _described(_merge(group), int(group["n"].iloc[0]), [] if found is None else list(map(int, found)))
        return pd.DataFrame([[key[0], described]], columns=["host", "wrapper"])

    salt = F.pmod(F.xxhash64("stream"), F.lit(SALTS)).alias("salt")
    streams = met.where("stream IS NOT NULL").select("host", salt, "stream", "counts")
    parts = streams.groupBy("host", "salt").applyInPandas(part, "host string, stream string, counts array<bigint>")
    total = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    known = parts.join(total, "host").join(common, "host", "left")
    return known.groupBy("host").applyInPandas(learn, "host string, wrapper string")


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` for every row of ``pages(page_id, url, html, …)``.

    A null page is empty and has an empty text; so has a page without main text. Pages without a
    readable host share one wrapper. Repeated rows are extracted each, other columns not read.
    """
    wrappers = _small(cut(host_wrappers(pages)))
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", "url", _host("url").alias("host"), "html")
    joined = rows.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            out = []
            for html, text in zip(batch["html"], batch["wrapper"], strict=True):
                text = text.as_py()
                if text not in known:
                    if len(known) > 500:
                        known = {None: None}
                    known[text] = json.loads(text)
                out.append(extract(html.as_py() or "", known[text]))
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(out, pa.string())], ["page_id", "url", "text"]
            )

    return joined.mapInArrow(run, f"page_id {kind}, url string, text string")
