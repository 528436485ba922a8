import zlib

import public_tokenizers
import pytest

import __spark_entry__
import corpus_pipeline
from tabloom.llm.common import components
from tests.llm.test_classifiers import corpus
from tests.llm.test_minhash import brute

CONTRACT = {
    "op2_toxicity_gated_network": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3_language_bloom_filters": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_embedding_pq_dedup": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5_url_boosted_trees": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op6_retrieval_packing": {c: "bigint" for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")},
    "op7_minhash_near_dedup": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op8_inverted_multi_index": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op9_warc_chunked_records": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op10_quality_additive_model": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op11_dual_tree_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint", "codebooks_sha256": "string"},
    "op12_ns_bounds_clusters": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
    "op13_winnowing_decontamination": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_contract(spark, name):
    found = dict(__spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").dtypes)
    assert {c: found.get(c) for c in CONTRACT[name]} == CONTRACT[name]


def test_all_queries_are_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()} and "pipeline" in names


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    docs, marks = corpus(spark)
    doubles = docs.where("doc_id < 40").withColumn("doc_id", docs["doc_id"] + 1000)
    docs.union(doubles).write.parquet(f"{folder}/documents.parquet")
    marks.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").cache()
    (_, good), (_, mild), (_, single), (_, packed) = corpus_pipeline.STAGES
    one = good(spark, docs, tables)
    assert one.columns == docs.columns
    ids = {r.doc_id for r in one.collect()}
    good_ids = {r.doc_id for r in docs.collect() if r.doc_id % 1000 % 3}
    assert len(ids ^ good_ids) <= 3
    two = mild(spark, one, tables)
    assert two.columns == docs.columns
    left = [r.doc_id for r in two.collect()]
    assert sum(i % 1000 % 4 == 0 for i in left) <= 0.1 * len(left) and sum(i % 1000 % 4 != 0 for i in left) >= 0.9 * sum(i % 1000 % 4 != 0 for i in ids)
    three = single(spark, two, tables)
    assert three.columns == docs.columns
    kept = {r.doc_id for r in three.collect()}
    roots = brute([(r.doc_id, r.text) for r in two.collect()], 80)
    assert kept == set(roots.values())
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    tokens = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in three.collect()}
    rows = packed(spark, three, tables).collect()
    assert {r.doc_id: sum(p.length for p in rows if p.doc_id == r.doc_id) for r in rows} == tokens


def test_run_and_empty_tables(spark, tables, tmp_path):
    assert corpus_pipeline.run(spark, tables).count() > 0
    spark.read.parquet(f"{tables}/documents.parquet").where("1 = 0").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tables}/labels.parquet").where("1 = 0").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_components(spark):
    edges = [(k, k + 1) for k in range(50, 0, -1)] + [(100, 100), (None, 3), (200, 201), (201, 200), (300, 1)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 1 for k in range(1, 52)}, 300: 1, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_held_out_fold(spark):
    rows = __spark_entry__.queries()["op10_quality_additive_model"](spark, "/root/testdata/sf0.001").select("doc_id", "held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
