"""The queries of this subpackage, over (spark, sf_dir), and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .ann_multi_index import approximate_top_k
from .bpe import bpe_round_trip
from .common import read_table
from .html_extract import extract_main_text
from .jaccard_join import jaccard_components
from .mixing import pfair_mix
from .quality_rules import quality_scores
from .sharding import lpt_shards
from .suffix_dedup import repeat_digest
from .token_files import token_digests
from .topk_cover_tree import exact_top_k
from .toxicity import fit_examples, toxicity_scores
from .vector_codes import vector_codes
from .vector_sql import vector_codes_sql, yinyang_sql
from .yinyang import yinyang_clusters


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit_examples(docs, read_table(spark, sf_dir, "labels")))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(read_table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(read_table(spark, sf_dir, "documents"), default_vocabulary())


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt_shards(read_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digest(read_table(spark, sf_dir, "documents"))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair_mix(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "mix_source", "mix_block", "mix_slot", "mix_release", "mix_deadline", "mix_position"
    )


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate_top_k(read_table(spark, sf_dir, "embeddings"))


def op11_yinyang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang_clusters(read_table(spark, sf_dir, "embeddings"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(read_table(spark, sf_dir, "embeddings"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(read_table(spark, sf_dir, "documents"), default_vocabulary())


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def oracle_sql() -> dict[str, str]:
    return {
        "op11_yinyang": yinyang_sql(),
        "op12_vector_codes": vector_codes_sql(),
        "op2_topk": """
            WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
                       WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
            s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
                  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
            r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    }
