"""Near-duplicates taken out of a table of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import bounded, checkpointed

#: Documents that go (16 bytes each) that are broadcast at most.
BROADCAST_KEYS = 200_000


def keep_first(docs: DataFrame, shingle: int = jaccard.SHINGLE, similarity: tuple[int, int] = jaccard.SIMILARITY) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns: the first by
    doc_id (null last), then shingle set and text hash; of equal rows one.

    Documents link where their five-word shingles have a Jaccard similarity of 0.8 or
    more, and that is decided on the shingles themselves. Fingerprints of the shingles
    are the first candidate search, by multi-index hashing; since 64 bits can't tell
    all copies at 0.8, least those that differ by one block, buckets of shared
    shingles then find every other link (see jaccard.roots).

    Null and empty texts are one text without words, and so copies of each other; very
    long texts are compared whole; an empty table gives no rows; other columns stay,
    whatever their names. Of rows that are equal in doc_id and text and differ in other
    columns one stays whole, the least of all columns.

    Groups are decided on ids and hashes. Those that go meet the texts again by
    doc_id and text hash, broadcast while they are few. Rows that repeat the one
    which stays can't be told apart so; where there are any, only they are grouped."""
    own = checkpointed(jaccard.prefixes(docs, shingle, similarity))
    roots = jaccard.roots(own, docs, similarity, shingle)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "text_hash")
    counts = own.groupBy("doc_id", "text_hash", "fp").agg(F.count("*").alias("n"))
    counts = checkpointed(counts.join(roots, counts.fp == roots.class_fp).select(rank.alias("rank"), "root", "n"))
    first = checkpointed(counts.groupBy("root").agg(F.min("rank").alias("first")))
    gone = counts.join(first, "root").select(F.col("rank.doc_id").alias("_id"), F.col("rank.text_hash").alias("_hash"), (F.col("rank") == F.col("first")).alias("twin"), "n").where("n > 1 or not twin")
    gone = checkpointed(gone)
    twins = gone.where("twin")
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", F.xxhash64("text").alias("text_hash"))

    def meet(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = F.broadcast(keys) if bounded(keys, BROADCAST_KEYS) else keys
        return rows.join(keys, (rows.text_hash == keys._hash) & rows.doc_id.eqNullSafe(keys._id), how)

    kept = meet(rows, gone, "left_anti").select("_row.*")
    if bounded(twins, 0):
        return kept
    once = meet(rows, twins, "left_semi").groupBy("doc_id", "text_hash").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return kept.unionByName(once.select("_row.*"))
