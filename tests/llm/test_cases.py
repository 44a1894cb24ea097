"""Odd rows: nulls, empty and very long texts, ties, repeats, empty tables, clashing columns."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
import reference
import sentencepiece

from earshot.llm import (
    block_naming,
    byte_model,
    cross_parse,
    metric_tree,
    near_dedup,
    pieces,
    poisson_mix,
    private_data,
    quality,
    wrappers,
)
from earshot.llm import queries as llm
from earshot.session import ensure_checkpoint_dir
from earshot.sources.commits import listed

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, copy string, ids int, "
    "score string, _row int, n int, spans string, _quality int"
)
LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(60_000))
LINE = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [
    (0, None), (1, ""), (2, " \t\n"), (3, "x"), (4, LINE), (5, LINE), (6, LINE.upper()),
    (7, LINE.replace(" ", "\n")), (8, LINE + " thirteen"), (9, LONG), (10, LONG + " tail"),
    (11, "a" * 40_000), (12, "日本語 テキスト 🙂"), (None, LINE), (None, None), (13, LONG),
    (14, "ONE two"), (15, "one TWO"), (4, LINE), (16, "\x0b\x0c a\r\nb"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (i, t, None if i in (3, 4) else "en", None if i == 5 else "s", None, "c", 7, "z", 1, 2, "q", 3)
        for i, t in TEXTS
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_pieces(odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=llm.piece_model())
    got = pieces.encode_decode(odd, llm.piece_model(), keep=("doc_id", "text", "ids")).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert r["ids"] == library.encode(r["text"] or "", add_bos=True, add_eos=True)
        assert r["decoded"] == library.decode(r["ids"])
    assert pieces.encode_decode(none, llm.piece_model()).count() == 0


def test_heap_and_step_agree():
    with open(llm.piece_model(), "rb") as file:
        encoder = pieces.PieceEncoder(file.read())
    words = [" the", "   ", " a\n\tb", " 日本🙂é", " " + "ab" * 20, " <s>", " x", " �"]
    assert encoder.in_step(words) == [encoder.by_heap(w) for w in words]


def test_a_difference_from_the_library_fails():
    with open(llm.piece_model(), "rb") as file:
        encoder = pieces.PieceEncoder(file.read())
    encoder.ranks = encoder.ranks[::-1].copy()
    with pytest.raises(ValueError, match="library"):
        encoder.encode(["the internationalization of everything"])


def test_language(odd, none):
    samples = cross_parse.language_samples(odd)
    assert set(samples) == {"en"}
    got = cross_parse.identify(odd, {"en": [LINE], "xx": ["zzz qqq"]}).collect()
    by = {(r["doc_id"], r["lang_pred"]) for r in got}
    assert len(got) == len(TEXTS)
    assert {(0, "und"), (1, "und"), (2, "und"), (4, "en"), (6, "en")} <= by
    assert all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in cross_parse.identify(odd, {}).collect()} == {"und"}
    assert cross_parse.language_samples(none) == {}
    assert cross_parse.identify(none, {}).count() == 0


def test_cross_parse_counts_greedy_phrases():
    parser = cross_parse.CrossParser({"a": ["banana bandana"], "b": ["cabbage"]})
    text = "banana cab" * 60
    symbols, sizes, _ = parser.symbols([text])
    for k, sample in enumerate(("banana bandana", "cabbage")):
        phrases = 0
        for start in range(0, len(text), cross_parse.WINDOW):
            window, i = text[start : start + cross_parse.WINDOW], 0
            breaks, at = 0, ""
            while i < len(window):
                if at + window[i] in sample and window[i] in sample:
                    at += window[i]
                else:
                    breaks += 1
                    at = window[i] if window[i] in sample else ""
                i += 1
            phrases += breaks + 1
        assert parser.phrases(symbols, sizes)[k, 0] == phrases


def test_quality(spark, odd, none):
    labels = spark.createDataFrame(
        [(4, 1, 0), (4, 1, 0), (8, 1, 0), (11, 0, 0), (12, 0, 0), (None, 1, 0), (3, None, 0)],
        "doc_id bigint, quality int, toxic int",
    )
    model = quality.train(odd, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score(odd, model).columns == [c for c in odd.columns if c != "score"] + ["score"]
    kept = quality.drop_poor(odd, labels)
    assert kept.columns == odd.columns
    assert quality.train(none, labels)[1] == 0.0
    assert quality.train(odd, labels.where("false"))[1] == 0.0
    assert quality.drop_poor(none, labels).count() == 0


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(odd, none, words):
    got = near_dedup.near_duplicates(odd, words, 80).collect()
    assert len(got) == len(TEXTS)
    expected = reference.near_components({i: t for i, t in TEXTS if i is not None}, words, 80)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == expected[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])
    kept = near_dedup.drop_near_copies(odd, words)
    assert kept.columns == odd.columns
    assert near_dedup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("block", [4_096, 16])
def test_near_duplicates_in_long_lists(spark, monkeypatch, block):
    """Chains of edits, crowds around one text, and texts that share a passage only."""
    import random

    monkeypatch.setattr(near_dedup, "BLOCK", block)

    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(60))
    docs, i = {}, 0
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(70)]
        for _ in range(40):
            text = list(base)
            for _ in range(rng.randint(0, 9)):
                text[rng.randrange(70)] = f"e{rng.randrange(10**6)}"
            docs[i] = " ".join(text)
            i += 1
        for _ in range(25):  # a chain: each differs a little from the one before
            base[rng.randrange(70)] = f"c{rng.randrange(10**6)}"
            docs[i] = " ".join(base)
            i += 1
    for _ in range(40):
        docs[i] = passage + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(rng.randint(5, 60)))
        i += 1
    for n in range(30):
        docs[i] = f"short common words {n % 4}"
        i += 1
    got = near_dedup.near_duplicates(
        spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), 2, 80
    )
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got.collect()}
    assert found == reference.near_components(docs, 2, 80)


def test_model(spark, odd, none):
    got = byte_model.score_texts(odd).collect()
    assert len(got) == len(TEXTS)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (0, 1, 2)} == {1}
    assert byte_model.score_texts(none).count() == 0
    untaught = byte_model.score_texts(odd.where("doc_id = 3"), folds=1, held_out=0).collect()
    assert [(r["base_score"], r["train_tokens"], r["n_known"]) for r in untaught] == [(0.0, 0, 0)]


def test_model_against_the_definition(spark):
    import zlib

    docs = [(i, t) for i, t in enumerate(["banana", "bandana", None, "", "ana bana", "é日", "abracadabra banal"])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    training = [t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    for r in byte_model.score_texts(df).collect():
        expected = reference.ppm_digits(docs[r["doc_id"]][1], training)
        assert r["score"] == pytest.approx(-expected, rel=1e-5)


@pytest.mark.parametrize("contexts, cache", [(1, 1_000_000), (40, 1_000_000), (40, 1), (300, 30)])
def test_model_rare_contexts_serve_inside_words(spark, monkeypatch, contexts, cache):
    import random
    import zlib

    rng = random.Random(contexts)
    vocabulary = ["banana", "bandana", "Banana", "abracadabra", "anabasis", "é日本語", "x" * 40, "ab" * 8, "ba" * 8 + "n", "an"]
    docs = [(i, rng.choice([" ", "\n", "  "]).join(rng.choices(vocabulary, k=rng.randrange(9)))) for i in range(40)]
    docs += [(40, None), (41, " banana"), (42, "bandana "), (43, "abracadabandanabanana")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    training = [t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    monkeypatch.setattr(byte_model, "CONTEXTS", contexts)
    monkeypatch.setattr(byte_model, "CACHE", cache)
    monkeypatch.setattr(byte_model, "BUCKET", 100)
    for r in byte_model.score_texts(df).collect():
        expected = reference.ppm_digits(docs[r["doc_id"]][1], training, contexts=contexts)
        assert r["score"] == pytest.approx(-expected, rel=1e-5), docs[r["doc_id"]]


@pytest.mark.parametrize("contexts, cache", [(1, 1_000_000), (40, 1), (300, 30)])
def test_model_rare_contexts_serve_across_words(spark, monkeypatch, contexts, cache):
    """Whatever the table of frequent contexts leaves out, scores are those of the whole trie."""
    import zlib

    rng = random.Random(contexts)
    vocabulary = ["banana", "bandana", "a", "an", "é日本語", "x" * 40, "ab" * 8, "ba" * 8 + "n", "\n", " "]
    docs = [(i, rng.choice([" ", "  "]).join(rng.choices(vocabulary, k=rng.randrange(9)))) for i in range(40)]
    docs += [(40, None), (41, "  banana \n"), (42, "qzw unseen"), (43, "an a an abandana")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    training = [t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    monkeypatch.setattr(byte_model, "CONTEXTS", contexts)
    monkeypatch.setattr(byte_model, "CACHE", cache)
    monkeypatch.setattr(byte_model, "BUCKET", 100)
    for r in byte_model.score_texts(df, across=True).collect():
        expected = reference.ppm_digits(docs[r["doc_id"]][1], training)
        assert r["score"] == pytest.approx(-expected, rel=1e-5), docs[r["doc_id"]]
    untaught = byte_model.score_texts(df.where("doc_id = 3"), folds=1, held_out=0, across=True).collect()
    assert untaught[0]["base_score"] == 0.0 and untaught[0]["score"] < 0


def test_model_tables_hold_only_bytes_of_training_and_runs_asked_for(spark):
    docs = [(False, "abcdefgh abcdefgh"), (True, "abcdefghz"), (False, None)]
    rows = spark.createDataFrame(docs, "held_out boolean, text string").fillna("")
    counts = byte_model.corpus_counts(rows, across=True)
    runs = {r["key"].to_bytes(6): (r["n"], r["asked"]) for r in counts.where(f"kind = {byte_model.GRAM}").collect()}
    # Six bytes inside a word are its unit's, whatever text holds them; across a start they are asked for.
    assert runs[b"abcdef"] == (2, False) and runs[b"h abcd"] == (1, True)
    assert b"defghz" not in runs
    model = byte_model.ByteModel(byte_model.byte_levels(counts))
    # Eight letters, a space and the end mark; one column for all other bytes.
    assert len(model.table) == 11 * len(model.level_of)


def test_model_leaves_only_tables_that_scores_are_read_from(spark, odd):
    folder = ensure_checkpoint_dir(spark)
    before = set(listed(spark, folder))
    out = byte_model.score_texts(odd, across=True)
    new = {path.rsplit("/", 1)[1].split("-")[0] for path in set(listed(spark, folder)) - before}
    assert {"gains", "units"} <= new and not new & {"counts", "scored"}
    # Shuffle files are dropped early only inside.
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert out.count() == len(TEXTS)


def test_model_counts_rare_words_by_the_join(spark, odd, monkeypatch):
    whole = {tuple(r) for r in byte_model.score_texts(odd).drop("score").collect()}
    monkeypatch.setattr(byte_model, "CACHE", 50)
    joined = {tuple(r) for r in byte_model.score_texts(odd).drop("score").collect()}
    assert {r[:5] for r in whole} == {r[:5] for r in joined}
    assert sorted(r[5] for r in whole) == pytest.approx(sorted(r[5] for r in joined))


PAGES = [
    (0, "http://a.example/1", None),
    (1, "http://a.example/2", ""),
    (2, None, "<p>Only  text &amp; &#233;"),
    (3, "no url", "<html><body><nav><a href=x>Menu</a></nav><div class='cookie-notice'>Yes?</div>"
        "<main><h1>T</h1><p>One<b> two</b><p>three<script>var x='<p>no</p>'</script>"
        "<section class=comments><p>me too</p></section></main><footer>f</footer>"),
    (4, "http://b.example/x", "<div><p>x</p>" * 3_000),
    (4, "http://b.example/x", "<div><p>x</p>" * 3_000),
    (5, "http://b.example/y", "plain < text > with & signs"),
    (None, "http://b.example/z", "<article><ul><li>a<li>b</ul><form>f<p>g</form><!-- c --> d</article>"),
]


def test_pages(spark):
    frame = spark.createDataFrame(
        [(*p, "w") for p in PAGES], "page_id bigint, url string, html string, wrapper string"
    )
    got = {(r["page_id"], r["url"]): r["text"] for r in wrappers.main_text(frame).collect()}
    assert got[0, "http://a.example/1"] == got[1, "http://a.example/2"] == ""
    assert got[2, None] == "Only text & é"
    assert got[3, "no url"] == "T\nOne two\nthree"
    assert got[4, "http://b.example/x"] == "\n".join(["x"] * 3_000)
    assert got[5, "http://b.example/y"] == "plain < text > with & signs"
    assert got[None, "http://b.example/z"] == "a\nb\nd"
    assert wrappers.main_text(frame).count() == len(PAGES)
    assert wrappers.main_text(frame.where("false")).count() == 0


def test_broken_markup_takes_time_in_proportion():
    import random
    import time

    rng = random.Random(1)
    tags = ["<p>", "</p>", "<div>", "<b>", "</div>", "<li>", "x", "<i>", "</li>", "<tr>"]
    start = time.time()
    for page in ("<a" * 200_000, "<a \"" * 100_000, "<!-" * 200_000, "<div>" * 50_000 + "</p>" * 50_000, "".join(rng.choices(tags, k=60_000))):
        wrappers.extract(page, {"places": ["p", "#"], "roles": ".m", "optional": [], "article": False})
    assert time.time() - start < 60


def test_wrapper_learns_slots_options_and_repeats():
    pages = [
        f"<div><b>Site</b></div><ul>{'<li><a>x</a></li>' * n}</ul><div><p>{'text ' * n}</p></div>"
        + ("<div><i>more</i></div>" if n % 2 else "")
        for n in (2, 3, 4, 5)
    ]
    import json

    wrapper = json.loads(wrappers.wrapper_of(pages))
    assert wrapper["places"].count("li") == 1 and wrapper["optional"]
    assert [wrappers.extract(p, wrapper) for p in pages[:1]] == ["text text"]


def test_long_pages_are_learned_and_matched_whole():
    import json
    import random
    import time

    rng = random.Random(5)
    forms = ["<p>@{}</p>", "<div>@{}</div>", "<h2>@{}</h2>", "<ul><li>@{}</li></ul>", "<pre>@{}</pre>"]
    body = "".join(rng.choice(forms).format(i) for i in range(4_000))
    pages = [f"<h1>Title {n}</h1>{body.replace('@', f'text {n} ')}<h4>All rights kept</h4>" for n in range(4)]
    start = time.time()
    wrapper = json.loads(wrappers.wrapper_of(pages))
    lines = wrappers.extract(pages[0], wrapper).split("\n")
    assert len(lines) == 4_001 and "All rights kept" not in lines
    other = "".join(rng.choice(forms).format(i) for i in range(6_000))
    assert len(wrappers.extract(other, wrapper).split("\n")) == 6_000
    assert time.time() - start < 60


def test_what_most_pages_of_a_host_share_is_frame_in_articles_too(spark):
    notice = "<p>Subscribe to our letter</p>"
    rows = [(i, f"http://h.example/{i}", f"<article><p>one {i}</p>{notice}<p>two {i}</p></article>") for i in range(9)]
    rows += [(20 + i, "http://few.example/", f"<article><p>{i}</p>{notice}</article>") for i in range(2)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(frame).collect()}
    assert all(got[i] == f"one {i}\ntwo {i}" for i in range(9))
    assert got[20] == "0\nSubscribe to our letter"


def test_wrappers_come_from_all_pages_of_a_host(spark):
    import json

    rows = [(i, "http://h.example/", f"<div><p>{i}</p></div>") for i in range(300)]
    rows += [(300 + i, "http://h.example/", f"<div><p>{i}</p></div><dl><dt>rare {i}</dt></dl>") for i in range(2)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    [found] = wrappers.host_wrappers(frame).collect()
    wrapper = json.loads(found["wrapper"])
    assert wrapper["places"] == "div p # /p /div dl dt # /dt /dl".split()
    assert wrapper["optional"] == [5, 6, 7, 8, 9]


def vectors(spark, n=300, dim=8):
    import random

    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[7][1]) for i in range(60)]  # copies: ties
    rows += [(400, None), (420, []), (440, [float("nan")] * dim), (460, [None] * dim),
             (480, [1.0, 2.0]), (500, [float("inf")] * dim), (None, rows[3][1]), (20, rows[20][1])]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def test_top_k(spark, monkeypatch):
    from math import floor, isfinite

    for name, size in (("SHARD", 50), ("PAGE", 6), ("BLOCK", 4)):
        monkeypatch.setattr(metric_tree, name, size)
    rows, frame = vectors(spark)
    good = [
        (i, [floor(64 * x) for x in v]) for i, v in rows
        if i is not None and v and all(x is not None and isfinite(x) for x in v)
    ]
    expected = set()
    for q, v in {i: v for i, v in good if i % 20 == 0}.items():
        scores = sorted(
            (-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v)
        )
        expected |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:20])}
    got = [tuple(r) for r in metric_tree.top_k(frame).collect()]
    assert set(got) == expected and len(got) == len(set(got))
    assert metric_tree.top_k(frame.where("false")).count() == 0


def test_tree_leaves_out_far_pages():
    import numpy as np

    rng = np.random.default_rng(1)
    centres = rng.normal(0, 400, (40, 16))
    points = np.rint(np.repeat(centres, 100, 0) + rng.normal(0, 4, (4000, 16)))
    tree = metric_tree.MTree(points)
    visited = []
    search = tree.pages.copy()

    class Seen(list):
        def __getitem__(self, i):
            visited.append(i)
            return list.__getitem__(self, i)

    tree.pages = Seen(search)
    none = np.full(1, -np.inf)
    n, rows, score = tree.search(points[:1], 5, np.array([-1]), np.arange(4000), none)
    best = np.sort(points @ points[0])[::-1][:5]
    assert sorted(score)[::-1][:5] == best.tolist()
    assert len(set(visited)) < len(search) / 2


def test_personal_data(spark, odd, none):
    assert private_data.find_private(odd).count() == len(TEXTS)
    assert private_data.find_private(none).count() == 0
    hard = [
        "a@b.c@d.e.", "x@y", "1.2.3.4.5.6.7.8", "999.1.1.1", "+1 (017) 555-7713 473696257",
        "4111 1111 1111 1111", "4111-1111-1111-1112", "+12345", "a@" * 50 + "b.co", "9" * 3000,
        "." * 5000 + "@x.y", "+1 2 3 4 5 6 7 8 9 0 ((", "00001.2.3.4 é 12345678901234567890123",
    ]
    for text in hard:
        assert private_data.base_spans(text) == reference.base_spans(text), text


def test_bootstrap_finds_what_confident_context_vouches_for(spark):
    rows = [(i, f"please write to user{i}@mail.example.com today") for i in range(12)]
    rows += [(50, "please write to jane [at] mail [dot] example [dot] org today")]
    rows += [(60, "nothing (at) all.here"), (None, "call us"), (50, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [(r["doc_id"], [(s["kind"], s["start"], s["stop"]) for s in r["spans"]])
           for r in private_data.find_private(frame).collect()]
    found = dict(x for x in got if x[1])
    text = rows[12][1]
    end = text.index(" today")
    assert found[50] == [("email", text.index("jane"), end)]
    assert 60 not in found and len(found) == 13


def test_bootstrap_goes_on_until_nothing_is_new(spark):
    def span(i):
        return f"user{i} [at] mail [dot] example [dot] org"

    # Round n vouches for value n through word n, which is sure only from value n - 1 on.
    rows = [f"word0 user{i}.known@mail.example.com x{i}" for i in range(9)] + [f"word0 {span(0)} y0"]
    for n in range(1, 6):
        rows += [f"word{n} b{n}user{i}@mail.example.com z{n}q{i}" for i in range(8)]
        rows += [f"word{n} {span(n - 1)} v{n}", f"word{n} {span(n)} w{n}"]
    frame = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in private_data.find_private(frame).collect()}
    assert all(len(got[i]) == 1 for i in range(len(rows)))


def test_confident_patterns_extract_other_shapes(spark):
    def luhn_number(i):
        head = f"4111 1111 1111 {i:03d}"
        return next(f"{head}{d}" for d in range(10) if private_data.luhn((head + str(d)).replace(" ", "")))

    rows = [f"my visa {luhn_number(i)} expires" for i in range(12)]
    rows += [f"please ring +49 30 12345{i:02d}77 tonight" for i in range(12)]
    rows += [f"kindly write user{i}@mail.example.com today" for i in range(12)]
    odd = [
        ("my visa 12 4111 1111 1111 1111 expires", "card", "4111 1111 1111 1111"),
        ("please ring 030/123 45 67 tonight", "phone", "030/123 45 67"),
        ("kindly write jane at mail dot example dot org today", "email", "jane at mail dot example dot org"),
    ]
    plain = ["we met at home dot org, in 1990 1991 1992", "page 030/123 45 68 of 200"]
    texts = rows + [t for t, _, _ in odd] + plain
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in private_data.find_private(frame).collect()}
    for i, (text, kind, part) in enumerate(odd, len(rows)):
        assert [(s["kind"], text[s["start"] : s["stop"]]) for s in got[i]] == [(kind, part)]
    assert all(len(got[i]) == 1 for i in range(len(rows)))
    assert not got[len(texts) - 1] and not got[len(texts) - 2]


def planted_corpus(rng):
    """Texts with the values that base patterns miss: ``(text, [(kind, value)])``, and decoys without any."""

    def digits(n):
        return "".join(rng.choices("123456789", k=n))

    def card(gap):
        head = "4" + digits(14)
        whole = next(head + str(d) for d in range(10) if private_data.luhn(head + str(d)))
        return gap.join(whole[i : i + 4] for i in range(0, 16, 4))

    def name():
        return "".join(rng.choices("abcdefghijklmnoprstuvw", k=7))

    frames = {
        "email": ["please write to {} today", "send mail for {} directly", "reply at address {} soon"],
        "ip": ["blocked host {} yesterday", "login came from {} again", "the server {} answered"],
        "card": ["charged visa {} twice", "paid with card {} online", "refund onto {} pending"],
        "phone": ["please ring {} tonight", "her mobile is {} now", "call us on {} anytime"],
    }
    known = {
        "email": lambda: f"{name()}@{name()}.example.com",
        "ip": lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)),
        "card": lambda: card(rng.choice(["", " ", "-"])),
        "phone": lambda: f"+49 {digits(3)} {digits(6)}",
    }
    unseen = {
        "email": lambda: rng.choice(["{} [at] {}.example.org", "{} (at) {} (dot) org", "{} at {} dot org"]).format(name(), name()),
        "ip": lambda: "[.]".join(str(rng.randrange(1, 255)) for _ in range(4)),
        "card": lambda: card(rng.choice([".", "/"])),
        "phone": lambda: rng.choice([f"0049 {digits(3)} {digits(6)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"0{digits(2)}/{digits(3)} {digits(2)} {digits(2)}"]),
    }
    out = []
    for kind, texts in frames.items():
        for frame in texts:
            out += [(f"{name()} {frame.format(known[kind]())} {name()}", []) for _ in range(120)]
            for _ in range(8):
                value = unseen[kind]()
                out.append((f"{name()} {frame.format(value)} {name()}", [(kind, value)]))
    decoys = ["order {0} {1} shipped", "pages {0}/{1} of the book", "we met at {2} dot com", "between 1990 and 2024 {0}",
              "version 1 . 2 . 3 . 4 of {2}", "sum {0} {1} {0} units", "total {1}{0}{1}"]
    out += [(rng.choice(decoys).format(digits(4), digits(5), name()), []) for _ in range(400)]
    return out


def test_bootstrap_recall_and_precision_on_planted_values(spark):
    import random

    corpus = planted_corpus(random.Random(3))
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(corpus)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["spans"] for r in private_data.find_private(frame).collect()}
    planted = {(i, k, v) for i, (_, values) in enumerate(corpus) for k, v in values}
    added = {
        (i, s["kind"], t[s["start"] : s["stop"]])
        for i, (t, _) in enumerate(corpus)
        for s in got[i]
        if (s["start"], s["kind"], s["stop"]) not in private_data.base_spans(t)
    }
    missed, wrong = planted - added, added - planted
    print(len(planted), len(missed), len(wrong), sorted(missed)[:20], sorted(wrong)[:20])
    assert len(missed) <= 0.1 * len(planted)
    assert len(wrong) <= 0.05 * len(added)


def test_loose_spans_take_time_in_proportion():
    import time

    start = time.time()
    for text in ("1 " * 300_000, "a at b dot " * 60_000, "at " * 200_000, "9" * 300_000, "1.2 . 3 " * 80_000):
        private_data.loose_spans(text, [], [])
    assert time.time() - start < 60


def test_exact_groups(odd, none):
    import re

    got = block_naming.exact_groups(odd, block=64).collect()
    assert len(got) == len(TEXTS)
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), i is None, i))
    for r in got:
        members = next(m for m in groups.values() if r["doc_id"] in [x[2] for x in m] and len(m) == r["group_size"])
        assert r["keep_id"] == min(members)[2] and r["kept"] == (r["doc_id"] == r["keep_id"])
    once = block_naming.drop_copies(odd, block=64)
    assert once.columns == odd.columns
    assert block_naming.exact_groups(none).count() == 0
    assert block_naming.drop_copies(none).count() == 0


def test_blocks_of_any_size_agree(odd):
    def rows(size):
        return sorted(map(str, block_naming.exact_groups(odd, block=size).collect()))

    assert rows(7) == rows(1000) == rows(10**6)


def test_mix(spark, none):
    rows = [(i, "word " * 9, "a" if i % 3 else None, "x") for i in range(6_000)] + [(None, None, "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, copy string")
    out = poisson_mix.poisson_mix(docs, {"a": 1.0, None: 3.0})
    assert out.columns == ["doc_id", "text", "source", "copy", "shuffle_key"]
    n = {r[0]: r[1] for r in out.groupBy("source").count().collect()}
    assert n["a"] == pytest.approx(1_500, rel=0.1) and n[None] == pytest.approx(4_500, rel=0.1)
    again = poisson_mix.poisson_mix(docs.repartition(7), {"a": 1.0, None: 3.0})
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))
    large = poisson_mix.poisson_mix(docs.limit(50), {"a": 1.0, None: 1.0}, total=50 * 46 * 200.0)
    assert large.count() == pytest.approx(10_000, rel=0.1)
    only = poisson_mix.poisson_mix(docs, {"a": 1.0})
    assert only.where("source IS NULL").count() == 0
    assert poisson_mix.poisson_mix(none).count() == 0


def test_places_are_independent_of_the_batch():
    from earshot.llm.words import utf8, word_hashes, word_places

    texts = ["a b", None, "", " A\tb ", "日 b", "x" * 600_000 + " a"]
    data, at = utf8(pa.array(texts))
    starts, ends, first = word_places(data, at)
    hashes = word_hashes(data, starts, ends)
    assert first.tolist() == [0, 2, 2, 2, 4, 6, 8]
    alone = utf8(pa.array(["x" * 600_000]))
    assert hashes[6] == word_hashes(alone[0], *word_places(*alone)[:2])[0]
    assert hashes[0] == hashes[2] == hashes[7] and hashes[1] == hashes[3] == hashes[5]


def test_tiny_sets_lose_no_link():
    """Sets of one stratum, which the runs can't tell: every pair at the threshold shares a key."""
    draw = np.random.default_rng(4)
    for _ in range(300):
        union = int(draw.integers(2, near_dedup.TINY + 1))
        top = np.uint64(int(draw.integers(near_dedup.STRATA)) << 59)
        values = np.unique(draw.integers(0, 1 << 58, union).astype(np.uint64) | top)
        lost = int(draw.integers(0, len(values) // 5 + 1))
        gone = draw.permutation(len(values))[:lost]
        part = int(draw.integers(0, lost + 1))
        a, b = np.delete(values, gone[:part]), np.delete(values, gone[part:])
        assert np.isin(near_dedup.without_few(a), near_dedup.without_few(b)).any()


def test_pairs_of_one_stratum_are_linked(spark):
    """Two-word shingles of words that differ in one, for sets of 1 to 12 values, found by their keys."""
    hashes = {}
    rows, n = [], 0
    draw = np.random.default_rng(8)
    for size in range(1, 13):
        for _ in range(40):
            text = " ".join(f"w{draw.integers(300)}" for _ in range(size + 1))
            rows += [(n, text), (n + 1, f"{text} w{draw.integers(300)}"), (n + 2, text[:-1] + "x")]
            n += 3
    hashes = reference.near_components(dict(rows), 2, 80)
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(table, 2, 80).collect()}
    assert got == hashes
    exact = [(1, "w113 w301 w399 w262 w155"), (2, "w113 w301 w399 w262 w155 w231")]
    got = near_dedup.near_duplicates(spark.createDataFrame(exact, "doc_id bigint, text string"), 2, 80).collect()
    assert {r["component_id"] for r in got} == {1}


def test_rows_that_repeat_an_id_are_judged_by_their_texts(spark):
    texts = ["one two three four five six seven", "other words of another text here", "ONE two three four five six seven x y"]
    rows = [(1, texts[0], "a"), (1, texts[1], "b"), (2, texts[0], "c"), (2, texts[2], "d"), (3, texts[1] + " ", "e"),
            (None, texts[0], "f"), (4, "one  two", "g"), (4, "one two", "h")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, mark string")
    kept = {r["mark"] for r in block_naming.drop_copies(docs).collect()}
    assert kept == {"a", "d", "e", "f", "g"}
    kept = {r["mark"] for r in near_dedup.drop_near_copies(docs).collect()}
    assert {"a", "b", "d", "f"} <= kept and "c" not in kept


def test_crowds_are_verified_alike_in_cells_and_pair_by_pair(spark, monkeypatch):
    draw = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):  # a crowd in which some pairs reach the threshold and others don't
        words = list(base)
        for at in draw.permutation(60)[: int(draw.integers(1, 5))]:
            words[at] = f"x{draw.integers(9)}"
        rows.append((i, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = reference.near_components(dict(rows), 2, 80)
    for cell, block in ((1 << 24, 4096), (0, 4096), (1 << 24, 7), (2000, 7)):
        monkeypatch.setattr(near_dedup, "CELL", cell)
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(table, 2, 80).collect()}
        assert got == want


def test_cells_of_a_crowd_return_members_and_a_forest(spark, monkeypatch):
    """All pairs of 40 texts are likely and linked: 40 members and 39 links leave a cell, not 780 pairs."""
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(40)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    sketched = near_dedup.sketches(table, 2).selectExpr(
        "32L AS key", "0L AS low", "0L AS high", "0L AS piece", "doc_id AS id", "doc_id AS root", "-1L AS main",
        "n", "marks", "kept", "whole", "true AS alike",
    )
    group = sketched.toPandas()
    assert sum(len(b) for _, b in near_dedup._likely_pairs(group, 80)) == 780
    members = near_dedup._with_likely_pairs(80)(group)
    assert len(members) == 40
    held = spark.createDataFrame(members)
    for cell, most in ((1 << 24, 39), (10_000, 780)):
        monkeypatch.setattr(near_dedup, "CELL", cell)
        links = near_dedup.linked_in_cells(held, table, 2, 80).collect()
        assert len({r["a"] for r in links} | {r["b"] for r in links}) == 40
        assert len(links) <= most


def test_the_word_table_is_bounded_by_bytes(monkeypatch):
    with open(llm.piece_model(), "rb") as file:
        encoder = pieces.PieceEncoder(file.read())
    monkeypatch.setattr(pieces, "TABLE", 20_000)
    monkeypatch.setattr(pieces, "SLICE", 500)
    texts = [" ".join(f"w{i}x{k}" for k in range(40)) + " " + "long" * 60 for i in range(80)]
    got = encoder.encode(texts)
    assert len(encoder.table) < 400 and not any(len(w) > pieces.SHORT for w in encoder.table)
    library = encoder.library
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_metric_tree_is_exact_with_large_components(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(1e6, 1.1e7) for _ in range(5)]) for i in range(300)]
    # Scores that differ by one, far beyond what a double tells apart, and ties.
    rows += [(1000 + i, [1e7, 1e7, 1e7, 1e7 + i % 3 / 64, 1 / 64]) for i in range(90)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    got = [tuple(r) for r in metric_tree.top_k(vectors).collect()]
    want = []
    for q in sorted(i for i in whole if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scored[:20], 1)]
    assert max(r[3] for r in want) > 1 << 53
    assert sorted(got) == want
    huge = spark.createDataFrame([(1, [1e12])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        metric_tree.top_k(huge).collect()
