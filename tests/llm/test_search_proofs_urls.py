"""Ranked search, Merkle proofs and URL filters against plain forms, on odd and random rows."""

import fnmatch
import random
import re

import numpy as np
import pytest
import reference

from earshot.llm import lexical, merkle, url_filter

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, rank int, tree string"


def spread(spark, rows):
    return spark.createDataFrame([(*r, 7, 8, "t") for r in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def odd():
    long = " ".join(f"w{i % 977} und{i % 31}" for i in range(200_000))
    texts = [
        (0, None), (1, ""), (2, " \t.,"), (3, "one"), (4, "One TWO three"), (5, "one two three"),
        (6, long), (7, "a" * 300_000), (8, "日本語 é🙂É x-y_z"), (None, "one two"), (None, None), (4, "One TWO three"),
        (9, "two two two one"), (10, long + " one"), (11, "\x00one\x7ftwo"),
    ]
    langs = ["en", None, "de", "", "é"]
    return [(i, t, langs[k % 5], None if k % 4 == 0 else "s", None if k % 3 == 0 else k) for k, (i, t) in enumerate(texts)]


ITEMS = [(0, "one two one"), (1, None), (2, "..."), (3, "W5 und7 w5 é🙂É 日本語"), (None, "two"), (0, "three"), (4, "unknown")]


def by_rank(found):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=str)


def test_ranked_search_of_odd_rows(spark, odd):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = [r[:2] for r in odd]
    for k in (1, 2, 20):
        assert by_rank(lexical.rank(spread(spark, odd), items, k)) == sorted(reference.ranked(docs, ITEMS, k), key=str)
    empty = spark.createDataFrame([], DOCS)
    assert lexical.rank(empty, items).count() == 0
    assert lexical.rank(spread(spark, odd), items.limit(0)).count() == 0
    assert lexical.rank(spread(spark, odd), items.where("item_id = 2")).count() == 0


@pytest.mark.parametrize("leaf, together, shard", [(1, 1, 50), (3, 4, 7), (48, 32, 8192)])
def test_ranked_search_of_random_rows_with_many_ties(spark, monkeypatch, leaf, together, shard):
    for name, value in (("LEAF", leaf), ("TOGETHER", together), ("SHARD", shard), ("BLOCK", 300)):
        monkeypatch.setattr(lexical, name, value)
    draw = random.Random(leaf)
    words = [f"w{i}" for i in range(40)]
    docs = [(i, " ".join(draw.choices(words, k=draw.randint(1, 30)))) for i in range(150)]
    docs += [(1000 + i, "w1 w2 w3") for i in range(60)]
    items = [(i, " ".join(draw.choices(words, k=8))) for i in range(15)] + [(99, "w1 w2 w3")]
    rows = [(*d, None, None, None) for d in draw.sample(docs, len(docs))]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert by_rank(lexical.rank(spread(spark, rows), asked)) == sorted(reference.ranked(docs, items), key=str)


def test_bounds_are_never_below_a_score():
    draw = np.random.default_rng(1)
    which, sizes = [], []
    for _ in range(200):
        held = draw.choice(30, draw.integers(1, 20), replace=False)
        which.append(held)
        sizes.append(len(held))
    which = np.concatenate(which)
    shard = lexical.Shard(
        np.arange(200), draw.integers(20, 99, 200), which, draw.integers(1, 9, len(which)), np.array(sizes),
        draw.integers(1, 9000, 30), 200, 9999,
    )
    for _ in range(500):
        term = draw.integers(30)
        low, high = np.sort(draw.integers(shard.begin[term], shard.begin[term + 1] + 1, 2))
        at, top = shard.greatest(np.array([low]), np.array([high]))
        assert top[0] == max(shard.impact[low:high], default=0)
        assert low == high or (low <= at[0] < high and shard.impact[at[0]] == top[0])


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_proofs_of_odd_and_many_rows(spark, odd, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    rows = odd + [(i, f"text {i}", ("fr", "it", "x" * (i % 3))[i % 3], "s", i) for i in range(100, 157)]
    want = reference.manifest([(r[0], r[3], r[2], r[4], r[1]) for r in rows])
    made = merkle.manifest(spread(spark, rows))
    got = merkle.prove(made).collect()
    assert len(got) == len(rows) and {r["leaf"] for r in got} == set(want)
    for r in got:
        doc_id, subroot, root, proof = want[r["leaf"]]
        if sum(x["leaf"] == r["leaf"] for x in got) > 1:
            assert r["doc_id"] == doc_id and r["root"] == root  # equal rows have a proof each
            continue
        assert (r["doc_id"], r["subroot"], r["root"], r["siblings"]) == (doc_id, subroot, root, proof)
        assert r["proof_sha256"] == reference.sha("".join(proof))
        assert (r["folded_root"] == root) == (r["tampered"] is None)
    some = spark.createDataFrame([(3,), (9,), (101,), (150,), (151,), (12345,)], "doc_id bigint")
    part = merkle.prove(made, some).collect()
    assert sorted(r["doc_id"] for r in part) == [3, 9, 101, 150, 151]
    full = {r["doc_id"]: r for r in got}
    assert all(r == full[r["doc_id"]] for r in part)


def test_proofs_of_few_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert merkle.prove(merkle.manifest(empty)).count() == 0
    one = merkle.prove(merkle.manifest(spread(spark, [(1, "x", None, None, None)]))).first()
    assert one["root"] == one["leaf"] == one["subroot"] == one["folded_root"] and one["siblings"] == []
    assert one["tampered"] is None and one["proof_sha256"] == reference.sha("")


def test_missing_nodes_are_the_least():
    for n in (1, 2, 3, 7, 12, 33):
        for _ in range(40):
            known = np.array(sorted(random.sample(range(n), random.randint(1, n))))
            below = {(0, i) for i in known.tolist()} | set(merkle.missing(known, n))
            assert merkle.missing(np.arange(n), n) == []
            size, level = n, 0
            while size > 1:  # all on the way up follows, and nothing is there twice
                for i in range(-(-size // 2)):
                    there = [(level, j) in below for j in (2 * i, 2 * i + 1) if j < size]
                    if all(there):
                        assert (level + 1, i) not in below
                        below.add((level + 1, i))
                    else:
                        assert not any(there)
                size, level = -(-size // 2), level + 1
            assert (level, 0) in below


URLS = [
    None, "", "no scheme", "://", "http://", "http://example.org", "http://Example.ORG/es/", "http://a.example.org/es/x?y#z",
    "http://badexample.org/es/", "http://x.org/en/1", "http://example.org/en/12", "http://m.example.org/en/2",
    "https://WWW.Shop.com/fr/7", "https://shop.com/de/7#top", "https://shop.com/de", "https://shop.com?/de/",
    "http://casino-win.example.com/en/", "http://x.net/casino/", "http://x.net#casino", "http://ads-x.net", "http://x.ads-y.net/a",
    "http://xads-y.net/", "http://user@spam.net/", "a://b://casino/", "http://ÉCASINO.net/É", "http://org/x", "http://com:80/de/",
    "http://x.net/" + "a" * 100_000, "http://" + "casin" * 10_000 + "o.net/",
]


def plain_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = raw.translate(reference.LOWER), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fit = [(-len(h + p), h + p, v) for v, h, p in url_filter.RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return host, path, min(fit)[1], min(fit)[2]
    bad = any(fnmatch.fnmatchcase(host, p) for _, p in url_filter.GLOBS)
    return host, path, None, "block" if bad else "allow"


def test_urls(spark):
    rows = [(i % 25, u, "h", "r") for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string").repartition(2)
    got = url_filter.judge(pages).collect()
    want = [(i % 25, *plain_verdict(u)) for i, u in enumerate(URLS)]
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, [], [], "block").collect()} == {"block"}


def test_automaton_against_patterns():
    draw = random.Random(5)
    patterns = ["".join(draw.choices("ab?*/é", k=draw.randint(1, 90))) for _ in range(60)] + ["", "*", "*/*", "x" * 130]
    texts = ["".join(draw.choices("abé/", k=draw.randint(0, 40))) for _ in range(400)] + ["x" * 130, "x" * 129, "", "/"]
    patterns += [t[:3] + "*" + t[-2:] for t in texts[:40]]

    def form(p):
        head, slash, tail = p.partition("/")
        plain = {"*": ("[^/]*", ".*"), "?": ("[^/]", ".")}
        return re.compile("".join(
            plain[c][k] if c in plain else re.escape(c) for k, part in ((0, head), (1, slash + tail)) for c in part
        ), re.DOTALL)

    forms = [form(p) for p in patterns]
    found = url_filter.Automaton(patterns).first(texts)
    for text, got in zip(texts, found, strict=True):
        assert got == next((i for i, f in enumerate(forms) if f.fullmatch(text)), -1)
    assert url_filter.Automaton([]).first(["a", ""]).tolist() == [-1, -1]
    with pytest.raises(ValueError, match="wildcards"):
        url_filter.compiled([("allow", "*.org", "/")], [])
