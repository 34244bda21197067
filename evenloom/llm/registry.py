"""Queries of this subpackage: one for each operator, over the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, counts, exact, fingerprints, htmltext, language, mixing, quality, search, simhash, toxicity, vectors, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(_table(spark, sf_dir, "documents"), *bpe.public_vocabulary())


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edit_report(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_codes(_table(spark, sf_dir, "embeddings"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language(_table(spark, sf_dir, "documents"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_quality, op3_bpe, op4_token_counts, op5_warc, op6_exact_dedup, op7_mixing, op8_toxicity, op9_html_text, op10_fingerprints, op11_vector_codes, op12_language, op13_search)}



def vector_codes_sql() -> str:
    """The rounds of op11 one after the other: parts, then for every round the assignment and the next codebook."""
    parts, entries, rounds = vectors.PARTS, vectors.ENTRIES, vectors.ROUNDS
    steps = [
        """kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""part AS MATERIALIZED (SELECT vec_id, label, p, list_slice(v, p * len(v) // {parts} + 1, (p + 1) * len(v) // {parts}) AS x FROM kept, range({parts}) AS r(p))""",
        f"""first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {entries})""",
        "book0 AS MATERIALIZED (SELECT p, e, x AS c FROM part JOIN first USING (vec_id))",
    ]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT vec_id, label, p, x, arg_min(e, d * 100 + e) AS e, min(d) AS d FROM (
            SELECT vec_id, label, part.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM part JOIN book{k} ON part.p = book{k}.p) GROUP BY vec_id, label, p, x)""")
        if k < rounds:
            steps.append(f"""mean{k} AS (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m FROM near{k}, range(1, len(x) + 1) AS r(i) GROUP BY p, e, i) GROUP BY p, e)""")
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} AS b LEFT JOIN mean{k} AS m ON b.p = m.p AND b.e = m.e)""")
    steps.append(f"""out AS (SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{rounds} GROUP BY vec_id, label)""")
    steps.append(f"""digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})""")
    return "WITH " + ", ".join(steps) + " SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM out, digest"


ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": vector_codes_sql(),
    "op13_search": r"""
        WITH fold AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        docs AS (SELECT doc_id, len(terms) AS n, terms FROM fold WHERE len(terms) > 0),
        total AS (SELECT count(*) AS big_n, sum(n)::BIGINT AS l FROM docs),
        tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(terms) AS term FROM docs) GROUP BY doc_id, n, term),
        weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, total GROUP BY term),
        items AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        asked AS (SELECT item_id, term, count(*) AS q FROM items GROUP BY item_id, term),
        scores AS (SELECT item_id, doc_id, sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // l))))::BIGINT AS score
            FROM asked JOIN tf USING (term) JOIN weight USING (term), total GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0 QUALIFY rank <= 20
    """,
    "op5_warc": r"""
        WITH t AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, body, strlen(body) AS payload_bytes, sha1(body) AS hex FROM t),
        -- eight base-32 digits for every ten hexadecimal ones
        b AS (SELECT page_id, body, payload_bytes, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((CAST('0x' || substr(hex, 1 + 10 * (i // 8), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31) AS INTEGER), 1)), '') AS payload_digest FROM d),
        g AS (SELECT body, max(page_id) AS last FROM t GROUP BY body)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
        FROM b JOIN g USING (body)
    """,
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
        g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
        FROM t JOIN g ON t.body = g.body
    """,
}
