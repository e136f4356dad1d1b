"""Queries of this subpackage, by name; each reads its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftlog.llm import licenses


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlog.llm.licenses import scan_licenses

    return scan_licenses(_docs(spark, sf_dir))


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlog.llm.tokenization import encode_decode

    return encode_decode(_docs(spark, sf_dir), _path("word_bpe_49k.json"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlog.llm.quality import classify

    return classify(_docs(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlog.llm.toxicity import toxicity

    return toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlog.llm.packing import pack

    return pack(_docs(spark, sf_dir), _path("byte_bpe_50k.json"))


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlog.llm.vectors import near_vectors

    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlog.llm.passages import repeated_passages

    return repeated_passages(_docs(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlog.llm.token_counts import count_tokens

    return count_tokens(_docs(spark, sf_dir), _path("byte_bpe_50k.json"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlog.llm.jaccard import jaccard_components

    return jaccard_components(_docs(spark, sf_dir), k=4, percent=85)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlog.llm.fingerprints import edited_neighbours

    return edited_neighbours(_docs(spark, sf_dir))


def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlog.llm.pieces import encode_decode_pieces

    return encode_decode_pieces(_docs(spark, sf_dir), _path("piece_bpe_32k.model"), ("n_tokens", "ids_sha256", "decoded_sha256"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlog.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=32)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from siftlog.llm.spelling import spelling_variants

    return spelling_variants(_docs(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_bpe_round_trip, op3_quality, op4_toxicity, op5_packing, op6_near_vectors, op7_repeated_passages, op8_token_counts, op9_jaccard, op10_fingerprints, op11_pieces, op12_whitening, op13_spelling)}
ORACLES: dict[str, str] = {"op1_license_scan": licenses.oracle()}
