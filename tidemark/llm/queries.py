"""The registered queries of this subpackage: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boilerplate, infill, knn, langid, licences, mixing, packing, quality, setjoin, simhash, substring, whitening
from .common import table


OP8_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, q.e, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score FROM q JOIN v d ON q.vec_id <> d.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id, e ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""


def remainder(n: int) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = boilerplate.remove_boilerplate(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), "text")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), learn=remainder(4) != 2)
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = langid.identify(table(spark, sf_dir, "documents"), learn=remainder(5) != 0)
    return named.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licences.scan(docs.select(licences.document_path().alias("path"), "text"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.link(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.exact_top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op10_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return knn.search_index(knn.build_index(vectors), vectors, F.col("vec_id") % 20 == 0)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.transform(table(spark, sf_dir, "documents"), texts=False)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_line_dedup, op3_quality, op4_language, op5_licences, op6_ngram_jaccard, op7_substring_dedup, op8_exact_topk, op9_packing, op10_hnsw, op11_fill_in_middle, op12_simhash, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.OP1_SQL, "op2_line_dedup": boilerplate.OP2_SQL, "op5_licences": licences.OP5_SQL, "op6_ngram_jaccard": setjoin.OP6_SQL, "op7_substring_dedup": substring.OP7_SQL, "op8_exact_topk": OP8_SQL, "op11_fill_in_middle": infill.OP11_SQL}
