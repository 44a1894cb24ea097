"""The registered queries against plain forms of their definitions, at small scale."""

import hashlib
import html
import re
import zlib
from collections import Counter
from math import log10

import duckdb
import numpy as np
import pytest
import reference
import sentencepiece

from __spark_entry__ import queries
from earshot.llm import queries as llm

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows(spark, name, sf=SMALL):
    return [r.asDict() for r in queries()[name](spark, sf).collect()]


def texts(sf=SMALL):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def test_pieces_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=llm.piece_model())
    docs, got = texts(), rows(spark, "op1_sentencepiece")
    assert {r["doc_id"] for r in got} == set(docs) and len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        decoded = library.decode(ids).encode()
        assert r["decoded_sha256"] == hashlib.sha256(decoded).hexdigest()


def test_language_of_held_out_documents(spark):
    known = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{MIDDLE}/documents.parquet'").fetchall())
    got = rows(spark, "op2_cross_parse", MIDDLE)
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in got)
    assert all(0 <= r["score"] <= 1 for r in got)
    held = [r["lang_pred"] == known[r["doc_id"]] for r in got if r["held_out"]]
    assert len(held) > 100 and np.mean(held) > 0.97


def test_quality_of_held_out_documents(spark):
    known = dict(duckdb.sql(f"SELECT doc_id, quality FROM '{MIDDLE}/labels.parquet'").fetchall())
    got = rows(spark, "op3_subword_quality", MIDDLE)
    assert len(got) == 1000 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r["predicted"] == known[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in known]
    assert len(held) > 50 and np.mean(held) > 0.95


def test_near_components(spark):
    expected = reference.near_components(texts(), 2, 80)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows(spark, "op4_bottom_k")}
    assert got == expected


def test_model_scores(spark):
    docs = texts()
    training = {i: t for i, t in docs.items() if fold(i, 7) != 2}
    counts = Counter(w for t in training.values() for w in reference.words(t))
    total, types, ends = sum(counts.values()) + len(training), len(counts) + 1, len(training)
    got = {r["doc_id"]: r for r in rows(spark, "op5_byte_model")}
    assert set(got) == set(docs)
    for i, t in docs.items():
        numbers = [counts[w] for w in reference.words(t)] + [ends]
        base = sum(log10((c + 1) / (total + types + 1)) for c in numbers)
        r = got[i]
        assert (r["held_out"], r["train_tokens"]) == (fold(i, 7) == 2, total)
        assert (r["n_tokens"], r["n_known"]) == (len(numbers), sum(c > 0 for c in numbers))
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
        assert r["score"] < 0


def test_model_beats_word_counts_on_held_out_documents(spark):
    out = [r for r in rows(spark, "op5_byte_model", "/root/testdata/sf0.1") if r["held_out"]]
    assert len(out) > 100 and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def article(page):
    inner = re.search(r"<article>(.*?)(</article>|<footer|\Z)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner.replace("<br>", " ").replace("<b>", ""))
    return "\n".join(t for b in blocks if (t := " ".join(html.unescape(b).split())))


def test_main_text(spark):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{SMALL}/pages.parquet'").fetchall())
    got = rows(spark, "op6_wrappers")
    assert {r["page_id"]: r["text"] for r in got} == {i: article(p) for i, p in pages.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_personal_data(spark):
    docs = texts()
    for r in rows(spark, "op8_bootstrap"):
        base = reference.base_spans(docs[r["doc_id"]])
        for kind in ("email", "ip", "card", "phone"):
            assert r[f"n_{kind}"] == sum(k == kind for _, k, _ in base)
        joined = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) - {""} <= set(r["spans"].split(","))


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SMALL).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=llm.piece_model())
    docs = texts()
    assert out
    for r in out:
        assert r["ids"] == library.encode(docs[r["doc_id"]] or "", add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(r["ids"])
    kept = {r["doc_id"] for r in out}
    plain = [re.sub("[\x20\x09-\x0d]", "", docs[i] or "") for i in kept]
    assert len(set(plain)) == len(plain)
    roots = reference.near_components({i: docs[i] for i in kept}, 5, 80)
    assert all(root == i for i, (_, root) in roots.items())


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns
