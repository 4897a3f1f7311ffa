"""The registered queries of this subpackage: thin, production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import read


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets, secret_digest

    return secret_digest(scan_secrets(read(spark, sf_dir, "documents")))


def op4_warc_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify_held_out

    return identify_held_out(read(spark, sf_dir, "documents"))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents drawn, with their weights."""
    from .quality import resample

    drawn = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return drawn.filter("kept").select(drawn["id"].cast("long").alias("doc_id"), "log_weight", "n_grams")


def op8_fast_similarity_sketching(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each leak."""
    from .decontaminate import RUN, find_leaks

    leaks = find_leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), run=RUN)
    return leaks.select("doc_id", "item_id", "n_matched", "n_windows", "containment", "reworded")


def op5_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .topk_search import top_k

    return top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op7_hierarchical_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hpy_lm import score_held_out

    return score_held_out(read(spark, sf_dir, "documents"))


def op10_grouping_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scans,
        op2_template_decontamination,
        op3_importance_resampling,
        op4_warc_dictionary,
        op5_cover_tree_search,
        op6_pattern_packing,
        op7_hierarchical_pitman_yor,
        op8_fast_similarity_sketching,
        op9_language_id,
        op10_grouping_suffix_dedup,
    )
}
#: The others need tokenizers, trained models, sampling, or every string of every text; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op1_secret_scans": oracles.SECRETS,
    "op4_warc_dictionary": oracles.ARCHIVES,
    "op5_cover_tree_search": oracles.TOP_K,
    "op8_fast_similarity_sketching": oracles.NEAR_DUPLICATES,
}
