"""Rendezvous hashing of record keys over weighted shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_columns


def _winner(key: str, weights: list[float]) -> Column:
    """The shard with the largest -weight / ln(u), u uniform by the hash of key and
    shard. Ties go to the lower shard. A shard's score depends on no other shard, so
    one more shard takes keys only into itself."""
    scores = []
    for shard, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(shard)), 11).cast("double") + 0.5) / float(1 << 53)
        scores.append(F.struct((-F.lit(float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    return (-F.greatest(*scores)["shard"]) if len(scores) > 1 else F.lit(0)


def assign_shards(docs: DataFrame, weights: list[float], new_weight: float = 1.0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    shard and grown_shard (with one more shard of new_weight) depend on doc_id and
    the weights alone. Texts are read once and not shuffled: sizes and digests are
    checkpointed, partitions count their rows by shard (the driver gets at most
    partitions x shards counts), and each task numbers its own rows on from there,
    so a slot is gapless from 0 and no shard meets in one task, however large.

    Null text: size 1, digest 0. Null doc_ids share a shard, as equal doc_ids do;
    repeated rows get a slot each; an empty table gives no rows; other columns are
    ignored."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"), _winner("doc_id", weights).alias("shard"), _winner("doc_id", [*weights, new_weight]).alias("grown_shard"))
    held = checkpointed(rows)
    part = F.spark_partition_id()
    first, total = {}, {}
    for p, shard, n in sorted(held.groupBy(part.alias("part"), "shard").count().collect()):
        first[p, shard] = total.get(shard, 0)
        total[shard] = total.get(shard, 0) + n
    table = spark.sparkContext.broadcast(first)

    def factory():
        starts, seen = table.value, {}

        def step(cols):
            slots = []
            for key in zip(cols["part"], cols["shard"], strict=True):
                slots.append(seen.get(key, starts[key]))
                seen[key] = slots[-1] + 1
            return cols | {"slot": slots}

        return step

    return map_columns(held.withColumn("part", part), factory, "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int")
