"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import (
    block_naming,
    byte_model,
    cross_parse,
    lexical,
    merkle,
    metric_tree,
    near_dedup,
    pieces,
    poisson_mix,
    private_data,
    quality,
    url_filter,
    wrappers,
)
from earshot.llm.common import documents, fold

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def piece_model() -> str:
    """The vocabulary file that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@register
def op1_sentencepiece(spark, sf_dir):
    """Ids and decoded text of every document, as digests."""
    out = pieces.encode_decode(documents(spark, sf_dir), piece_model(), packed=True)
    return out.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


@register
def op2_cross_parse(spark, sf_dir):
    """The language of every document."""
    docs = documents(spark, sf_dir)
    named = cross_parse.identify(docs, cross_parse.language_samples(docs))
    return named.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


@register
def op3_subword_quality(spark, sf_dir):
    """The quality score of every document."""
    docs = documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@register
def op4_bottom_k(spark, sf_dir):
    """Components of documents that share 80 % of their two-word shingles."""
    return near_dedup.near_duplicates(documents(spark, sf_dir), words=2, percent=80)


@register
def op5_byte_model(spark, sf_dir):
    """How likely every document is to the model and to word counts."""
    return byte_model.score_texts(documents(spark, sf_dir), across=True)


@register
def op6_wrappers(spark, sf_dir):
    """The main text of every page."""
    text = wrappers.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return text.withColumn("n_chars", F.char_length("text").cast("long"))


@register
def op7_metric_tree(spark, sf_dir):
    """The 20 best neighbours of every twentieth vector."""
    return metric_tree.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@register
def op8_bootstrap(spark, sf_dir):
    """Personal data in every document: base spans as a digest, and all spans."""
    found = private_data.find_private(documents(spark, sf_dir))

    def number(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *(number(kind) for kind in private_data.KINDS),
        F.sha2(F.encode(private_data.span_text("base"), "UTF-8"), 256).alias("base_sha256"),
        private_data.span_text("spans").alias("spans"),
    )


@register
def op9_block_naming(spark, sf_dir):
    """Which document stays of those with equal text."""
    return block_naming.exact_groups(documents(spark, sf_dir))


@register
def op10_poisson_mix(spark, sf_dir):
    """Every source with the same share of the characters, the corpus size kept."""
    return poisson_mix.poisson_mix(documents(spark, sf_dir))


@register
def op11_interval_search(spark, sf_dir):
    """The 20 best documents of every benchmark item."""
    return lexical.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@register
def op12_octopus(spark, sf_dir):
    """Every document's leaf, and its proof against the manifest's root."""
    made = merkle.manifest(documents(spark, sf_dir))
    proofs = merkle.prove(made, siblings=False)
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@register
def op13_shift_and(spark, sf_dir):
    """Whether every page's URL is allowed, and by which rule."""
    judged = url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


SQL = {
    "op7_metric_tree": """
        WITH v AS (
            SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v))
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
            FROM scored) WHERE rank <= 20""",
    "op9_block_naming": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS plain
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY plain ORDER BY chars DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY plain) AS group_size,
               doc_id = first_value(doc_id) OVER (PARTITION BY plain ORDER BY chars DESC, doc_id) AS kept,
               sha256(plain) AS text_sha256
        FROM t""",
    "op10_poisson_mix": """
        WITH sizes AS (
            SELECT coalesce('=' || source, '') AS s, sum(length(coalesce(text, '')) + 1) AS chars
            FROM documents GROUP BY 1),
        rates AS (
            SELECT s, 1.0::DOUBLE / (SELECT count(*) FROM sizes)
                      * (SELECT sum(chars)::DOUBLE FROM sizes) / chars::DOUBLE AS rate
            FROM sizes),
        parts AS (
            SELECT s, greatest(1, ceil(rate / 64))::INTEGER AS n,
                   rate / greatest(1, ceil(rate / 64)) AS mean FROM rates),
        terms AS (
            SELECT s, n, k, exp(k * ln(mean) - mean - lgamma(k + 1)) AS p
            FROM parts, unnest(range(0, (mean + 12 * sqrt(mean) + 31)::INTEGER)) AS r(k)),
        sums AS (
            SELECT s, n, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS upto FROM terms),
        draws AS (
            SELECT doc_id, s, part,
                   (('0x' || substr(md5('mix|' || doc_id || '|' || part), 1, 13))::BIGINT + 0.5)
                       / 4503599627370496.0 AS u
            FROM (SELECT doc_id, coalesce('=' || source, '') AS s FROM documents)
            JOIN parts USING (s), unnest(range(1, n + 1)) AS r(part)),
        counts AS (
            SELECT doc_id, sum(hit) AS n FROM (
                SELECT d.doc_id, d.part, count(*) FILTER (upto < u) AS hit
                FROM draws d JOIN sums USING (s) GROUP BY d.doc_id, d.part)
            GROUP BY doc_id)
        SELECT documents.*, copy::INTEGER AS copy,
               ('0x' || substr(md5('mix|order|' || doc_id || '|' || copy), 1, 15))::BIGINT AS shuffle_key
        FROM documents JOIN counts USING (doc_id), unnest(range(1, n::BIGINT + 1)) AS r(copy)""",
    "op11_interval_search": r"""
        WITH lowered AS (
            SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
            FROM documents),
        words AS (
            SELECT doc_id, unnest(regexp_extract_all(
                text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM lowered),
        held AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
        sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY ALL),
        corpus AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM sizes),
        weights AS (
            SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT term, count(*) AS df FROM held GROUP BY term), corpus),
        asked AS (
            SELECT item_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark),
        scored AS (
            SELECT item_id, doc_id, sum(
                w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // length))))::BIGINT AS score
            FROM asked JOIN weights USING (term) JOIN held USING (term) JOIN sizes USING (doc_id), corpus
            GROUP BY item_id, doc_id)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
            FROM scored WHERE score > 0) WHERE rank <= 20""",
    "op12_octopus": """
        WITH RECURSIVE fields AS (
            SELECT doc_id, n_chars, coalesce('=' || lang, '') AS tree,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
                       || coalesce(strlen(source) || ':' || source, '-')
                       || coalesce(strlen(lang) || ':' || lang, '-') AS a,
                   coalesce(strlen(text) || ':' || text, '-') AS b
            FROM documents),
        bits AS (
            SELECT [list_reduce([i] || range(8), lambda c, k:
                       CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)
                    FOR i IN range(256)] AS part),
        crcs AS (
            SELECT doc_id, xor(list_reduce(
                       [4294967295::BIGINT] || [ascii(c)::BIGINT FOR c IN string_split(doc_id::VARCHAR, '')],
                       lambda c, x: xor(c >> 8, part[xor(c & 255, x) + 1])), 4294967295) AS crc
            FROM (SELECT DISTINCT doc_id FROM documents), bits),
        leaves AS (
            SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos,
                   count(*) OVER (PARTITION BY tree) AS n,
                   sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || b) AS leaf,
                   CASE WHEN crc % 7 = 0 AND n_chars IS NOT NULL
                        THEN sha256(a || strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) || b)
                        ELSE leaf END AS given
            FROM fields JOIN crcs USING (doc_id)),
        up AS (
            SELECT tree, 0 AS level, pos, leaf AS h, n FROM leaves
            UNION ALL
            SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
            FROM up WHERE n > 1 GROUP BY tree, level, pos // 2, n),
        subroots AS (
            SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos,
                   count(*) OVER () AS n
            FROM up WHERE n = 1),
        over AS (
            SELECT 0 AS level, pos, subroot AS h, n FROM subroots
            UNION ALL
            SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
            FROM over WHERE n > 1 GROUP BY level, pos // 2, n),
        proofs AS (
            SELECT doc_id, sha256(coalesce(string_agg(h, '' ORDER BY part, level), '')) AS proof_sha256
            FROM (SELECT doc_id, 0 AS part, level, h
                  FROM leaves l JOIN up u ON u.tree = l.tree AND u.n > 1 AND u.pos = xor(l.pos >> level, 1)
                  UNION ALL
                  SELECT doc_id, 1, level, h
                  FROM leaves l JOIN subroots s USING (tree)
                  JOIN over o ON o.n > 1 AND o.pos = xor(s.pos >> level, 1)
                  UNION ALL SELECT doc_id, 2, 0, '' FROM leaves)
            GROUP BY doc_id),
        low AS (
            SELECT doc_id, tree, 0 AS level, pos, n, given AS h FROM leaves
            UNION ALL
            SELECT f.doc_id, f.tree, f.level + 1, f.pos // 2, (f.n + 1) // 2,
                   sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END)
            FROM low f LEFT JOIN up s
              ON s.tree = f.tree AND s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1),
        high AS (
            SELECT doc_id, 0 AS level, s.pos, s.n, h FROM low JOIN subroots s USING (tree) WHERE low.n = 1
            UNION ALL
            SELECT f.doc_id, f.level + 1, f.pos // 2, (f.n + 1) // 2,
                   sha256(CASE WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END)
            FROM high f LEFT JOIN over s ON s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1),
        top AS (SELECT h AS root FROM over WHERE n = 1)
        SELECT doc_id, leaf, subroot, root, proof_sha256, high.h AS folded_root, high.h = root AS verified
        FROM leaves JOIN subroots USING (tree) JOIN proofs USING (doc_id)
        JOIN (SELECT * FROM high WHERE n = 1) high USING (doc_id), top""",
    "op13_shift_and": r"""
        WITH parts AS (
            SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM (
                SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3)
                                     ELSE '' END AS rest FROM pages)),
        split AS (
            SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM parts),
        ruled AS (
            SELECT *, '.' || host AS h, CASE
                WHEN h LIKE '%.example.org' AND path LIKE '/en/1%' THEN 'example.org/en/1'
                WHEN h LIKE '%.example.org' AND path LIKE '/es/%' THEN 'example.org/es/'
                WHEN h LIKE '%.com' AND path LIKE '/fr/%' THEN 'com/fr/'
                WHEN h LIKE '%.com' AND path LIKE '/de/%' THEN 'com/de/'
                WHEN h LIKE '%.org' AND path LIKE '/%' THEN 'org/' END AS rule FROM split)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN host LIKE '%casino%' OR host LIKE '%adult%' OR host LIKE '%spam%' OR host LIKE '%-pills.%'
              OR host LIKE '%-bets.%' OR h LIKE '%.ads-%' THEN 'block' ELSE 'allow' END AS verdict
        FROM ruled""",
}


def statements() -> dict[str, str]:
    return dict(SQL)
