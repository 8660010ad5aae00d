"""The numbered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import oracles
from brindle.session import table


def op1_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("slices")


def op2_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.quotes import build_conversations

    found = build_conversations(table(spark, sf_dir, "conversations"))
    body = F.col("body")
    return found.select(
        "conv_id", "turn", "role", F.length(body).cast("long").alias("body_chars"), F.md5(body).alias("body_md5"), F.col("n_quotes").cast("long").alias("n_quotes"),
        F.col("n_linked").cast("long").alias("n_linked"), F.col("quote_depth").cast("int").alias("quote_depth"), "parent_turn", "root_turn", F.col("reply_depth").cast("int").alias("reply_depth"), "position",
    )


def op3_heap_bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.token_count import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op4_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"))


def op6_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.hamming_search import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.language import fit, fold, predict_languages

    docs = table(spark, sf_dir, "documents")
    found = predict_languages(docs, fit(docs))
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


def op9_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.warc import archive_and_index

    index = archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", F.col("ts").alias("capture_ts"))


def op10_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.sentencepiece import encode

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    coded = encode(docs, decoded_col="decoded")
    return coded.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.size("ids").cast("long").alias("n_pieces"),
        F.xxhash64("ids").alias("ids_hash"),
        (F.col("decoded") == F.translate("text", "\u2581", " ")).alias("round_trip"),
    )


def op11_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.license_scan import license_report

    return license_report(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.token_alignment import align

    return align(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from brindle.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_sainte_lague_mix": op1_sainte_lague_mix,
    "op9_warc_index_merge": op9_warc_index_merge,
    "op10_sentencepiece_scan": op10_sentencepiece_scan,
    "op2_quotation_links": op2_quotation_links,
    "op3_heap_bpe_counts": op3_heap_bpe_counts,
    "op4_dart_minhash": op4_dart_minhash,
    "op5_line_quality": op5_line_quality,
    "op6_multi_index_hamming": op6_multi_index_hamming,
    "op7_viterbi_language": op7_viterbi_language,
    "op8_minimax_shards": op8_minimax_shards,
    "op11_license_diagonals": op11_license_diagonals,
    "op12_token_alignment": op12_token_alignment,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES = {
    "op2_quotation_links": oracles.QUOTATIONS,
    "op4_dart_minhash": oracles.NEAR_DUPLICATES,
    "op5_line_quality": oracles.QUALITY,
    "op9_warc_index_merge": oracles.ARCHIVES,
    "op11_license_diagonals": oracles.LICENSES,
    "op13_filter_audit": oracles.FILTER_AUDIT,
}
