"""Queries and pipeline on the smallest tables."""

from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from brute import brute_repeats, brute_spans
from kindred.llm import registry, toxicity
from kindred.llm.boosting import BoostedTrees, Isotonic

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


@pytest.mark.parametrize("name", ["op4_url_filters", "op6_arc_to_warc", "personal_data_base", "shard_laws"])
def test_queries_in_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, SF), con.sql(registry.ORACLES[name])
    order = [want.columns.index(c) for c in got.columns]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


#: Queries of other tables than documents, by their first letters.
TABLES = {"op6": ("pages", "page_id"), "warc": ("pages", "page_id"), "op13": ("conversations", "conv_id")}


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - {"op4_url_filters", "op12_time_partitions", "shard_laws"}))
def test_queries_cover_their_table(spark, name):
    table, key = next((t for k, t in TABLES.items() if name.startswith(k)), ("documents", "doc_id"))
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()}
    rows = registry.QUERIES[name](spark, SF).collect()
    assert len(rows) == len(want) and {r[key] for r in rows} == want


def test_stages(spark, tmp_path):
    docs = before = spark.read.parquet(f"{SF}/documents.parquet")
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == before.columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = after
    whole = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in docs.collect()}


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, gone long, spans string, email string, t string, id string, h int, band long, component string, score double, ids string"


def odd_documents(spark, rows):
    extra = (7, "s", "e", "t", "i", 1, 2, "c", 0.5, "x")
    return spark.createDataFrame([(*r, *extra) for r in rows], CLASHING)


def test_stages_take_odd_rows(spark):
    long = "jo (at) " + "ab." * 40_000 + "com"
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3), (None, "x@y.com and more", "en", "s", 16), (4, long, "en", "s", len(long)), (5, "q " * 60_000, "en", "s", 120_000)]
    docs = odd_documents(spark, rows)
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        assert out.count() >= 6
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            assert {(r.gone, r.spans, r.email, r.t, r.score) for r in out.collect()} == {(7, "s", "e", "t", 0.5)}
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.one_of_each_group(spark, docs, SF).where("doc_id = 3").count() == 1
    red = {r.doc_id: r for r in corpus_pipeline.redact_personal_data(spark, docs, SF).collect()}
    assert red[None].text == "<email> and more" and red[4].text == "<email_written>" and red[4].n_chars == len(red[4].text) and red[1].text is None


def test_contracts_of_queries(spark):
    """Digest columns against plain Python on the smallest tables."""
    import base64
    import hashlib
    import zlib

    hexed = lambda b: hashlib.sha256(b).hexdigest()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    media = {r.doc_id: r for r in registry.QUERIES["op8_media_fingerprints"](spark, SF).collect()}
    for d, t in texts.items():
        raw = t.encode()
        raw += bytes(-len(raw) % 64 if raw else 64)
        assert (media[d].n_bytes, media[d].payload_bytes, media[d].payload_sha256, media[d].tail_crc32) == (len(t.encode()), len(raw), hexed(raw), zlib.crc32(raw[-64:]))
    for r in registry.QUERIES["op3_balanced_shards"](spark, SF).collect():
        assert (r.size, r.text_crc32, r.law) == (len(texts[r.doc_id].encode()) + 16, zlib.crc32(texts[r.doc_id].encode()), "rows") and 0 <= r.shard < 40
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(registry.VOCABULARY)
    for r in registry.QUERIES["op10_bpe"](spark, SF).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        want = (len(ids), hexed(" ".join(map(str, ids)).encode()), hexed(library.decode(ids, skip_special_tokens=False).encode()))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want
    for r in registry.QUERIES["op2_personal_data"](spark, SF).collect():
        found = brute_spans(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(found[k]) for k in ("email", "ip", "card", "phone")]
        base = [f"{k}:{a}:{z}" for k in ("email", "ip", "card", "phone") for a, z in found[k]]
        assert r.base_sha256 == hexed(",".join(base).encode()) and r.spans.split(",")[: len(base)] == (base or r.spans.split(",")[:0])
        assert r.n_spans == (r.spans.count(",") + 1 if r.spans else 0)
    counts = {r.doc_id: r for r in registry.QUERIES["op7_repeated_passages"](spark, SF).collect()}
    said = {r.doc_id: r.n_passage_words for r in registry.QUERIES["repeated_word_passages"](spark, SF).collect()}
    for d, (n, gone, spans, rest, words) in zip(texts, brute_repeats(list(texts.values()), 400, 51), strict=True):
        r = counts[d]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, said[d]) == (n, gone, spans, hexed(rest), words)
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    last = {}
    for k in sorted(pages):
        last[pages[k]] = k
    for r in registry.QUERIES["op6_arc_to_warc"](spark, SF).collect():
        raw = pages[r.page_id]
        top = last[raw]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(raw), digest, *(("response", None) if top == r.page_id else ("revisit", top)))


@pytest.mark.parametrize("score", [0.29, 0.3, 0.4])
def test_rejects_what_the_operator_calls_toxic(spark, monkeypatch, score):
    trees = BoostedTrees().fit(np.zeros((4, len(toxicity.FEATURES))), np.array([0.0, 1, 0, 1]))
    model = toxicity.ToxicityModel(toxicity.Lexicon({}, {}), trees, Isotonic(np.array([0.0]), np.array([score])))
    monkeypatch.setattr(toxicity, "fit_toxicity", lambda *_: model)
    clean = {r.doc_id for r in registry.QUERIES["op1_toxicity"](spark, SF).where("predicted = 0").collect()}
    kept = corpus_pipeline.reject_toxic(spark, registry.table(spark, SF, "documents"), SF)
    assert {r.doc_id for r in kept.collect()} == clean and bool(clean) == (score < 0.3)
