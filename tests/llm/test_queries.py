"""The registered queries: their SQL, their columns, and the pipeline."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
sys.path.insert(0, str(ROOT / "tools"))

import compare  # noqa: E402
import corpus_pipeline  # noqa: E402
from foldloom.llm.queries import QUERIES, SQL  # noqa: E402

COLUMNS = {
    "op1_robust_outliers": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_token_counts": "doc_id n_bytes n_tokens over_limit",
    "op5_hash_index": "query_id rank vec_id score",
    "op7_jaccard_join": "doc_id n_shingles component_id",
    "op8_repeated_passages": "doc_id n_words n_removed kept_sha256",
    "op9_seekable_bundles": "page_id payload_bytes payload_digest record_type refers_to",
    "op10_bpe_lexicon": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op11_spelling_variants": "word form root n n_near form_n",
    "op12_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13_language_id": "doc_id held_out lang_pred score",
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, sf, monkeypatch, name):
    monkeypatch.setitem(compare.QUERIES, name, QUERIES[name])
    monkeypatch.setitem(compare.SQL, name, SQL[name])
    assert compare.compare(spark, compare.connect(sf), sf, name) is None


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf, name):
    assert set(COLUMNS[name].split()) <= set(QUERIES[name](spark, sf).columns)


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages_act(spark, sf, documents, words):
    """Each stage against what its operator says about its own input."""
    from foldloom.llm import cotraining, lexicon_bpe, overlap_join, passages, poisson_mix
    from foldloom.llm.queries import tokenizer

    docs, texts = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf).cache()
        before, after = ({r["doc_id"] for r in d.select("doc_id").collect()} for d in (docs, out))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == documents.columns
        if name == "quality classifier":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            assert after == {r[0] for r in cotraining.judge(docs, labels).filter("kept").collect()}
            assert after < before
        elif name == "n-gram Jaccard join":
            found = overlap_join.duplicate_classes(docs).collect()
            assert after == {r["component_id"] for r in found} and out.count() == len(after)
        elif name == "substring dedup":
            found = {r["doc_id"]: r["n_words"] - r["n_removed"] for r in passages.repeated_passages(docs).collect()}
            assert {r["doc_id"]: len(words(r["text"])) for r in out.collect()} == found
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
        elif name == "source mixing":
            found = {}
            for r in poisson_mix.replicate(docs).collect():
                found[r["doc_id"]] = max(found.get(r["doc_id"], 0), r["copy"])
            assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == found
            texts = {r["doc_id"]: r["text"] for r in docs.collect()}
        else:
            path = tokenizer("word_bpe_49k.json")
            encoder = lexicon_bpe.Encoder(path, None)
            for r in out.collect():
                ids = lexicon_bpe.encode_texts([texts[r["doc_id"]]], encoder)[0]
                assert bytes(r["ids"]) == ids.tobytes() and r["decoded"] == lexicon_bpe.decode_ids(bytes(r["ids"]), path)
        docs = out


def test_pipeline_of_an_empty_table(spark, sf, documents):
    docs = documents.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.count() == 0


def test_run_returns_the_last_stage(spark, sf):
    assert {"doc_id", "ids", "decoded"} <= set(corpus_pipeline.run(spark, sf).columns)
