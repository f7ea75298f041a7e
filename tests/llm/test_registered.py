"""Registered queries: SQL twins, contract columns, and the pipeline stage by stage."""

import hashlib
import os

import public_tokenizers as P
import pytest

import corpus_pipeline as pipeline
from plumeline.llm import bpe, phrases, secrets
from plumeline.llm.queries import QUERIES, SQL
from tests.test_queries import DATA, db, plain  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

COLUMNS = {
    "op2_collision_counting": {"vec_id", "n_links", "component_id", "kept"},
    "op5_warc_archive": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    "op6_secret_scan": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op7_benchmark_phrases": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op8_byte_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op9_repeated_passages": {"doc_id", "n_words", "n_removed", "kept_sha256"},
    "op10_site_style_tree": {"page_id", "url", "text", "n_chars"},
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, db, name):  # noqa: F811
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = db.execute(SQL[name])
    given = [c[0] for c in cursor.description]
    assert sorted(given) == columns
    assert sorted(tuple(map(plain, r)) for r in df.select(*columns).collect()) == sorted(tuple(plain(r[given.index(c)]) for c in columns) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    assert set(QUERIES[name](spark, DATA).columns) >= COLUMNS[name]


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").union(spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "", None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.union(docs.limit(3))
    rows = {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.written(stage(spark, docs, DATA), "test")
        rows[name] = {r.doc_id: r for r in docs.collect()}
        if name != "byte-level BPE":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert docs.count() == len(rows[name]) or name == "quality classifier"
    steps = [set(rows[n]) for n, _ in pipeline.STAGES]
    assert all(a >= b for a, b in zip(steps, steps[1:], strict=False))
    assert not {10**6, 10**6 + 1} & steps[0]
    items = [phrases.words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 13]) for w in items for i in range(max(1, len(w) - 12)) if w}

    def contaminated(text):
        own = phrases.words(text)
        hit = {k for size in {len(w) for w in windows} for i in range(len(own) - size + 1) if tuple(own[i : i + size]) in windows for k in range(i, i + size)}
        return bool(hit) and 20 * len(hit) >= len(own)

    assert steps[2] == {i for i, r in rows["near-duplicates"].items() if not contaminated(r.text)}
    for i, r in rows["secret scans"].items():
        assert r.text == secrets.redacted(rows["benchmark decontamination"][i].text, "[SECRET]")
        assert r.n_chars == len(r.text)
    ranks = {b: t for t, b in bpe.ranks(P.path("byte_bpe_multi_50k.tiktoken")).items()}
    for i, r in rows["byte-level BPE"].items():
        text = rows["secret scans"][i].text.encode()
        assert b"".join(ranks[x] for x in r.ids) == text
        assert r.decoded_sha256 == hashlib.sha256(text).hexdigest()


def test_rows_without_a_key(spark):
    """Rows without a doc_id are judged by their own texts, and stay out of near-duplicate classes."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    good = docs.where("doc_id = 0").first()
    rows = [(None, "@@@ ### XQZ $$$ &&& %%%", "en", "s", 1), (None, good.text, good.lang, "s", 1), (None, item, "en", "s", 1), (None, None, None, None, None)]
    given = docs.where("doc_id < 150").unionByName(spark.createDataFrame(rows, docs.schema))
    texts = lambda found: sorted((r.text or "") for r in found.where("doc_id IS NULL").collect())
    judged = pipeline.quality(spark, given, DATA)
    assert rows[0][1] not in texts(judged) and "" not in texts(judged)
    assert (good.text in texts(judged)) == bool(judged.where("doc_id = 0").count())
    assert len(texts(pipeline.near_duplicates(spark, given, DATA))) == 4
    assert texts(pipeline.decontamination(spark, given, DATA)) == sorted(r[1] or "" for r in (rows[0], rows[1], rows[3]))


def test_shared_keys(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(1)
    rows = [(1, "b some words of a text", "en", "s", 1), (1, "a some words of a text", "en", "s", 2), (2, "quite another text than those", "en", "s", 3)]
    found = pipeline.near_duplicates(spark, spark.createDataFrame(rows, docs.schema), DATA).collect()
    assert sorted((r.doc_id, r.text) for r in found) == [(1, "a some words of a text"), (2, "quite another text than those")]
