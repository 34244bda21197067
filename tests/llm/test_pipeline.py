"""The corpus pipeline against a plain version of every stage, and the registered queries' contracts."""

import hashlib
import itertools
import re

import numpy as np
import pytest

import corpus_pipeline
from evenloom.llm import bpe, mixing, registry, toxicity

from .test_corpus import plain_mixing


def plain_scores(texts, model):
    w, b = model
    out = []
    for t in texts:
        used = {f for word in set(toxicity.WORD.findall(t.lower())) for f in toxicity.word_features(word)}
        out.append(1 / (1 + np.exp(-np.clip(b + sum(np.float32(w[f]) for f in used), -30, 30))))
    return out


def plain_near(texts):
    """For each text the first of its group, linked by a Jaccard similarity of 0.8 or more of sets of five-word runs."""
    sets = []
    for t in texts:
        words = [w for w in re.split(rb"[\x20\x09-\x0D]+", re.sub(rb"[A-Z]+", lambda m: m[0].lower(), t.encode())) if w]
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        shared = len(sets[a] & sets[b])
        if not (sets[a] or sets[b]) or sets[a] and sets[b] and 5 * shared >= 4 * (len(sets[a]) + len(sets[b]) - shared):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(len(texts))]


def test_stages_equal_the_plain_version(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert [f.name for f in schema] == ["doc_id", "text", "lang", "source", "n_chars"]
    near = next(r for r in given if r[1] and len(r[1].split()) > 100)
    changed = near[1].split()
    changed[50] = "changed"
    rows = [*given, (given[3][0], given[4][1], "en", "src1", 1), (None, "a text of its own", None, None, None), (None, given[5][1], "en", "src1", 1), (90_001, " ".join(changed), "en", "src2", 2), (90_001, None, "en", "src2", 0), given[7]]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    smallest = lambda r: (r[0] is None, r[0] or 0)

    got = corpus_pipeline.drop_toxic(spark, docs, sf_dir)
    assert got.columns == docs.columns
    scores = plain_scores([r[1] or "" for r in rows], toxicity.train(docs, labels))
    left = [r for r, s in zip(rows, scores) if s < 0.5]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, left)) and len(left) < len(rows)

    got = corpus_pipeline.drop_copies(spark, spark.createDataFrame(left, schema), sf_dir)
    assert got.columns == docs.columns
    unique = {}
    for r in sorted(left, key=smallest):
        unique.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), r)
    unique = sorted(unique.values(), key=smallest)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, unique)) and len(unique) < len(left)

    got = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(unique, schema), sf_dir)
    assert got.columns == docs.columns
    firsts = plain_near([r[1] or "" for r in unique])
    single = [r for k, r in enumerate(unique) if firsts[k] == k]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, single)) and len(single) < len(unique)

    frame = spark.createDataFrame(single, schema)
    got = corpus_pipeline.mix(spark, frame, sf_dir)
    assert got.columns == docs.columns
    cells = [(r, *r["_cell"], r["_draw"]) for r in mixing.with_cells(frame).withColumn("_draw", mixing.draw()).collect()]
    assert [n for *_, n, _ in cells] == [len([w for w in re.split(r"[\x20\x09-\x0D]+", r[0]["text"] or "") if w]) for r in cells]
    weight = plain_mixing([c[1:5] for c in cells], None)
    top = max(weight.values())
    kept = [tuple(r)[:5] for r, s, l, t, n, draw in cells if draw < min(1.0, weight.get((s, l, t), 0.0) / top)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, kept))

    import tiktoken

    vocabulary, pattern = bpe.public_vocabulary()
    enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(vocabulary), special_tokens={})
    out = corpus_pipeline.tokenise(spark, spark.createDataFrame(kept, schema), sf_dir).collect()
    want = []
    for r in kept:
        ids = enc.encode_ordinary(r[1] or "")
        want.append((str(r[0]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(want)


def test_run_chains_the_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
    key = lambda r: (r.doc_id, r.n_tokens, r.ids_sha256)
    assert sorted(map(key, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(key, docs.collect()))


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "bpe"]


CONTRACTS = {
    "op1_simhash": ("documents", "doc_id bigint, fingerprint string, component_id bigint"),
    "op2_quality": ("documents", "doc_id bigint, score double"),
    "op3_bpe": ("documents", "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"),
    "op4_token_counts": ("documents", "doc_id bigint, n_tokens bigint"),
    "op5_warc": ("pages", "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"),
    "op6_exact_dedup": ("documents", "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string"),
    "op7_mixing": ("documents", "doc_id bigint, weight double, probability double, kept boolean"),
    "op8_toxicity": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
    "op9_html_text": ("pages", "page_id bigint, url string, text string, n_chars bigint"),
    "op10_fingerprints": ("documents", "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"),
    "op11_vector_codes": ("embeddings", "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string"),
    "op12_language": ("documents", "doc_id bigint, held_out boolean, lang_pred string, score double"),
}
#: Queries whose rows aren't their table's.
OTHERS = {"op13_search": "item_id bigint, rank int, doc_id bigint, score bigint"}


@pytest.mark.parametrize("name", CONTRACTS)
def test_queries_return_a_row_for_each_row_of_their_table(spark, sf_dir, name):
    table, columns = CONTRACTS[name]
    out = registry.QUERIES[name](spark, sf_dir)
    types = dict(out.dtypes)
    for c in columns.split(", "):
        field, kind = c.split()
        assert types[field] == kind
    key = {"pages": "page_id", "embeddings": "vec_id"}.get(table, "doc_id")
    given = sorted(r[0] for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key).collect())
    assert sorted(r[0] for r in out.select(key).collect()) == given
    sql = registry.ORACLE_SQL.get(name)
    if sql:
        import duckdb

        con = duckdb.connect()
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
        want = con.sql(sql)
        assert sorted(map(str, (tuple(r) for r in out.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
        assert sorted(want.columns) == sorted(out.columns)


def test_search_equals_its_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    out = registry.op13_search(spark, sf_dir)
    assert [f"{a} {b}" for a, b in out.dtypes] == OTHERS["op13_search"].split(", ")
    want = con.sql(registry.ORACLE_SQL["op13_search"])
    assert sorted(tuple(r) for r in out.select(*want.columns).collect()) == sorted(want.fetchall())


def test_queries_cover_the_operators():
    assert sorted(registry.QUERIES) == sorted([*CONTRACTS, *OTHERS])
