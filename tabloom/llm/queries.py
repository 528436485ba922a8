"""The registered queries of the operators: each applies its operator to the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabloom.llm import centroids, decontaminate, language, minhash, packing, quality, sentencepieces, toxicity, urls, vector_codes, vector_dedup, vector_search, warc
from tabloom.llm.common import held_out

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


def scored(documents: DataFrame, score: Column, least: float) -> DataFrame:
    out = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return out.withColumn("predicted", (F.col("score") >= least).cast("int"))


@query("op7_minhash_near_dedup")
def op7(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


@query("op9_warc_chunked_records")
def op9(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages"))


@query("op10_quality_additive_model")
def op10(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = quality.fit_quality(documents, table(spark, sf_dir, "labels"))
    return scored(documents, model.score(F.col("text")), 0.3)


@query("op2_toxicity_gated_network")
def op2(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(documents, table(spark, sf_dir, "labels"))
    return scored(documents, model.score(F.col("text")), 0.5)


@query("op6_retrieval_packing")
def op6(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op4_embedding_pq_dedup")
def op4(spark, sf_dir):
    return vector_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), threshold=0.9)


@query("op8_inverted_multi_index")
def op8(spark, sf_dir):
    found = vector_search.nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query("op1_sentencepiece_viterbi")
def op1(spark, sf_dir):
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = sentencepieces.round_trip(table(spark, sf_dir, "documents"), model)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
                        F.crc32(F.encode("decoded", "UTF-8")).alias("decoded_crc32"), (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("round_trip"))


@query("op3_language_bloom_filters")
def op3(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    filters = language.fit_languages(documents)
    found = filters.score(F.col("text"))
    out = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found.alias("found"))
    return out.select("doc_id", "held_out", "found.lang_pred", "found.score")


URL_RULES = [urls.parse_rule(text, verdict) for text, verdict in (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))]


@query("op5_url_boosted_trees")
def op5(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def lloyd_sql(points: str, start: str, rounds: int, key: str) -> tuple[str, str]:
    """Common tables of Lloyd's rounds over ``x (row, part, v)`` from ``e0 (part, entry, v)``; the last assignment and the last entries."""
    steps = [points, start]
    for t in range(rounds + 1):
        steps.append(f"""a{t} as materialized (select {key}, part, v, arg_min(entry, d * 100000 + entry) entry, min(d) d from (
            select x.{key}, x.part, x.v, e.entry, list_sum(list_transform(list_zip(x.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint d
            from x join e{t} e on x.part = e.part) group by {key}, part, v)""")
        if t < rounds:
            steps.append(f"""e{t + 1} as materialized (select e.part, e.entry, coalesce(m.v, e.v) v from e{t} e left join (
                select part, entry, list((s - ((s % n) + n) % n) // n order by pos) v from (
                    select part, entry, pos, sum(v[pos])::bigint s, count(*) n from a{t}, range(1, len(v) + 1) g(pos) group by part, entry, pos)
                group by part, entry) m on e.part = m.part and e.entry = m.entry)""")
    return ",\n".join(steps), f"a{rounds}"


KEPT_SQL = "embedding is not null and len(list_filter(embedding, lambda z: z is null or not isfinite(z))) = 0"
OP11_TABLES, OP11_LAST = lloyd_sql(f"""kept as materialized (select row_number() over (order by vec_id) row, vec_id, label,
        list_transform(embedding, lambda z: floor(1024 * z::double)::bigint) w from embeddings where {KEPT_SQL}),
    x as materialized (select row, part, w[part * len(w) // 4 + 1:(part + 1) * len(w) // 4] v from kept, range(0, 4) g(part))""",
    "e0 as materialized (select part, row - 1 entry, v from x where row <= 256)", 4, "row")
OP11_SQL = f"""with {OP11_TABLES},
    coded as (select row, string_agg(format('{{:02x}}', entry), '' order by part) code, sum(d)::bigint error from {OP11_LAST} group by row),
    books as (select sha256(string_agg(array_to_string(v, ','), ',' order by part, entry)) codebooks_sha256 from e4)
    select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error, codebooks_sha256
    from coded join kept using (row), books"""

OP12_TABLES, OP12_LAST = lloyd_sql(f"""x as materialized (select vec_id, row_number() over (order by sha256('1:' || vec_id)) row, 0 part,
        list_transform(embedding, lambda z: floor(64 * z::double)::bigint) v from embeddings where len(embedding) = 64 and {KEPT_SQL})""",
    "e0 as materialized (select part, row - 1 entry, v from x where row <= 16)", 3, "vec_id")
OP12_SQL = f"""with {OP12_TABLES}
    select vec_id, a.entry::int "cluster", d::bigint distance, (sum(d) over (partition by a.entry))::bigint cluster_inertia, (sum(d) over ())::bigint inertia,
        sha256(array_to_string(e.v, ',')) centroid_sha256
    from {OP12_LAST} a join e3 e on a.entry = e.entry"""


@query("op11_dual_tree_codes", OP11_SQL)
def op11(spark, sf_dir):
    coded = vector_codes.compress_vectors(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query("op12_ns_bounds_clusters", OP12_SQL)
def op12(spark, sf_dir):
    found = centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def words_sql(source: str, key: str) -> str:
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"select {key}, coalesce(regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) w from {source}"


OP13_SQL = f"""with docs as materialized ({words_sql("documents", "doc_id")}),
    items as materialized ({words_sql("benchmark", "item_id")}),
    sizes as (select item_id, w, least(10, len(w)) size from items where len(w) > 0),
    windows as materialized (select distinct item_id, size, array_to_string(w[pos:pos + size - 1], ' ') words
        from sizes, lateral (select unnest(range(1, len(w) - size + 2)) pos)),
    shown as (select doc_id, pos, size, array_to_string(w[pos:pos + size - 1], ' ') words
        from docs, (select distinct size from windows), lateral (select unnest(range(1, len(w) - size + 2)) pos)),
    hits as materialized (select doc_id, pos, s.size, item_id from shown s join windows i on s.size = i.size and s.words = i.words),
    marked as (select doc_id, count(distinct place) n_hit from (select doc_id, unnest(range(pos, pos + size)) place from hits) group by doc_id),
    named as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) ids
        from (select distinct doc_id, item_id::varchar item_id from hits) group by doc_id)
    select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(ids, '')) items_sha256,
        coalesce(n_hit, 0) > 0 contaminated
    from docs left join marked using (doc_id) left join named using (doc_id)"""


@query("op13_winnowing_decontamination", OP13_SQL)
def op13(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
