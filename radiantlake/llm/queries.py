"""The registered queries of the corpus operators: query name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read_table


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file is; the same on every machine of a cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_diff import extract_text

    return extract_text(read_table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import pii_spans

    return pii_spans(read_table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read_table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


#: Host, path and action of the filter that pages are judged by.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urlfilter import judge_urls, rule_table

    return judge_urls(read_table(spark, sf_dir, "pages"), rule_table(spark, URL_RULES))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(read_table(spark, sf_dir, "documents"))


def op8_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import assign_shards

    return assign_shards(read_table(spark, sf_dir, "documents"), [1.0] * 16)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fresh_folder
    from .secrets import findings

    return findings(read_table(spark, sf_dir, "documents"), path=fresh_folder(spark, "ledger"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_page_text, op2_pii, op3_packing, op4_simhash, op5_url_filter, op6_decontamination, op7_quality, op8_rendezvous, op9_secrets, op10_token_counts)
}
