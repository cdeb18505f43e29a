"""The registered queries of this package, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import (
    byte_bpe, exact_dedup, language_id, lexical_search, license_scan, lm_scoring, mixing, ngram_jaccard, quality_rules,
    simhash, spelling, token_counts, warc,
)
from driftline.llm.common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_language_id")
def op1(spark, sf_dir):
    held = fold(F.col("doc_id"), 4, 2)
    found = language_id.identify(table(spark, sf_dir, "documents"), ~held)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "lang_pred", "score", "accepted")


@query("op2_lm_scoring")
def op2(spark, sf_dir):
    scored = lm_scoring.score(table(spark, sf_dir, "documents"), ~fold(F.col("doc_id"), 7, 2))
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query(
    "op3_ngram_jaccard",
    r"""
    WITH RECURSIVE t AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^ 	-
]+') AS w
        FROM documents
    ),
    s AS (
        SELECT doc_id, list_sort(list_distinct(CASE
            WHEN len(w) = 0 THEN []::VARCHAR[]
            WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END)) AS tokens
        FROM t
    ),
    d AS (SELECT tokens, len(tokens) AS n, min(doc_id) AS rep FROM s GROUP BY tokens),
    e AS (SELECT rep, n, unnest(tokens) AS token FROM d),
    p AS (
        SELECT x.rep AS a, y.rep AS b
        FROM e x JOIN e y ON x.token = y.token AND x.rep < y.rep
        GROUP BY x.rep, y.rep, x.n, y.n
        HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
    ),
    g AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
    r(node, seen) AS (
        SELECT rep, rep FROM d WHERE n > 0
        UNION
        SELECT r.node, g.b FROM r JOIN g ON g.a = r.seen
    ),
    c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
    SELECT s.doc_id, CAST(d.n AS BIGINT) AS n_shingles,
           CASE WHEN d.n = 0 THEN s.doc_id ELSE c.component END AS component_id
    FROM s JOIN d ON s.tokens = d.tokens LEFT JOIN c ON c.node = d.rep
    """,
)
def op3(spark, sf_dir):
    return ngram_jaccard.jaccard_components(table(spark, sf_dir, "documents"))


@query("op4_quality_rules")
def op4(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    crf = quality_rules.train_crf(docs, table(spark, sf_dir, "labels"))
    return quality_rules.apply_rules(docs, crf)


@query(
    "op5_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    w AS (SELECT *, strlen(body) >= 1000 AS large, max(page_id) OVER (PARTITION BY body) AS answer FROM p)
    SELECT page_id,
           strlen(body) AS payload_bytes,
           sha1(body) AS payload_digest,
           CASE WHEN large AND page_id <> answer THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN large AND page_id <> answer THEN answer END AS refers_to
    FROM w
    """,
)
def op5(spark, sf_dir):
    records = warc.archive_and_read(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_byte_bpe")
def op6(spark, sf_dir):
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


@query("op7_mixing")
def op7(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op8_token_counts")
def op8(spark, sf_dir):
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query(
    "op9_exact_dedup",
    r"""
    WITH d AS (
        SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm
        FROM documents
    )
    SELECT doc_id,
           min(doc_id) OVER w AS keep_id,
           count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept,
           sha256(norm) AS text_sha256
    FROM d WINDOW w AS (PARTITION BY norm)
    """,
)
def op9(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query("op10_license_scan")
def op10(spark, sf_dir):
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


@query("op11_simhash")
def op11(spark, sf_dir):
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query("op12_spelling")
def op12(spark, sf_dir):
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


@query(
    "op13_lexical_search",
    r"""
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents WHERE text IS NOT NULL
    ),
    sizes AS (SELECT doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
    total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sizes),
    tf AS (
        SELECT doc_id, n, term, count(*) AS tf
        FROM (SELECT doc_id, n, unnest(terms) AS term FROM sizes) GROUP BY doc_id, n, term
    ),
    q AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark
    ),
    w AS (
        SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w
        FROM (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM q) GROUP BY term), total
    ),
    scored AS (
        SELECT item_id, doc_id,
               CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // words)))) AS BIGINT) AS score
        FROM q JOIN w USING (term) JOIN tf USING (term), total
        GROUP BY item_id, doc_id
    ),
    ranked AS (
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
        FROM scored WHERE score > 0
    )
    SELECT * FROM ranked WHERE rank <= 50
    """,
)
def op13(spark, sf_dir):
    return lexical_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
