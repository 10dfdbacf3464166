"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpointed, map_columns
from .components import connected_components

CHUNK = 1 << 16
#: Bits that linked fingerprints differ in at most.
RADIUS = 2
#: Bits of a segment, and what marks keys of the second one.
SEGMENT, SECOND = 32, 1 << 32
#: Fingerprints in a bucket beyond which it is split by the other segment; buckets (8 bytes each) that are broadcast at most.
CROWD, BROADCAST_BUCKETS = 32, 500_000


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits, the highest first."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The bits that are set in over half of n hashes."""
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of a whole text, unsigned 64 bit.

    A-Z are lower-cased, words are runs of anything but the six ASCII white-space
    characters, shingles count as often as they come; a shingle's hash is XXH64 (seed
    42). Fewer words than a shingle: the whole sequence is the one shingle; no words
    or null: zero. A very long text is hashed in chunks."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hash64, seed = xxhash.xxh64_intdigest, 42
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):  # bounds the memory of a very long text
        part = words[at : min(at + CHUNK, n) + shingle - 1]
        grams = zip(*(part[k:] for k in range(shingle)), strict=False) if len(words) >= shingle else [part]
        counts += bit_counts(np.array([hash64(b" ".join(g), seed) for g in grams], dtype=np.uint64))
    return majority(counts, n)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_hash, fp (the fingerprint's bits as a signed long) for every row."""

    def factory():
        def step(cols):
            fps = [fingerprint(t, shingle) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"], "fp": [signed(x) for x in fps]}

        return step

    return map_columns(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), factory, "doc_id bigint, text_hash bigint, fp bigint")


def _ball(value: Column, bits: int) -> list[Column]:
    """value, and value with each one of its bits flipped."""
    return [value, *(value.bitwiseXOR(F.lit(1 << i)) for i in range(bits))]


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b (a < b): all pairs of distinct fingerprints (column fp) at radius (2 or 3) or fewer differing bits.

    Multi-index hashing over two segments of 32 bits. The table holds every
    fingerprint under the value of either segment. A query enumerates the Hamming
    ball of radius 1 in the first segment; in the second it needs the value alone at
    radius 2, the ball at radius 3: no pair escapes both. What the table gives back
    agrees in a segment only; the distance of all 64 bits then rejects or links it.

    A bucket with over CROWD fingerprints would pair them all with its queries. It is
    split by the same indexing within the other segment, over halves of 16 bits, of
    which one is equal or one bit off; no pair is lost by that."""
    low, high = F.col("fp").bitwiseAND(F.lit(SECOND - 1)), F.shiftrightunsigned("fp", SEGMENT)
    table = fps.select("fp", F.explode(F.array(high, low + SECOND)).alias("key"))
    second = _ball(low, SEGMENT) if radius > 2 else [low]
    queries = fps.select("fp", F.explode(F.array(*_ball(high, SEGMENT), *(x + SECOND for x in second))).alias("key"))
    crowded = checkpointed(table.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select(F.col("key").alias("_crowded")))
    if bounded(crowded, 0):
        table, queries = (x.withColumn("part", F.lit(0)) for x in (table, queries))
    else:
        crowded = F.broadcast(crowded) if bounded(crowded, BROADCAST_BUCKETS) else crowded
        other = F.when(F.col("key") < SECOND, low).otherwise(high)
        first, last = F.shiftrightunsigned(other, 16), other.bitwiseAND(F.lit(0xFFFF)).bitwiseOR(F.lit(1 << 16))
        ends = [first, last], [*_ball(first, 16), *(_ball(last, 16) if radius > 2 else [last])]

        def split(rows: DataFrame, parts: list[Column]) -> DataFrame:
            parts = F.when(F.col("_crowded").isNotNull(), F.array(*parts)).otherwise(F.array(F.lit(-1).cast("bigint")))
            return rows.join(crowded, F.col("key") == F.col("_crowded"), "left").select("fp", "key", F.explode(parts).alias("part"))

        table, queries = split(table, ends[0]), split(queries, ends[1])
    q, t = queries.alias("q"), table.alias("t")
    near = (F.col("q.fp") < F.col("t.fp")) & (F.bit_count(F.col("q.fp").bitwiseXOR(F.col("t.fp"))) <= radius)
    met = q.join(t, (F.col("q.key") == F.col("t.key")) & (F.col("q.part") == F.col("t.part")) & near)
    return met.select(F.col("q.fp").alias("a"), F.col("t.fp").alias("b")).distinct()


def _named(fps: DataFrame, stars: DataFrame) -> DataFrame:
    """class_fp, root of every fingerprint."""
    return checkpointed(fps.join(stars, fps.fp == stars.node, "left").select(F.col("fp").alias("class_fp"), F.coalesce("root", "fp").alias("root")))


def _roots(own: DataFrame) -> DataFrame:
    """class_fp, root for every distinct fingerprint of own; equal roots are linked."""
    distinct = own.select("fp").distinct()
    return _named(distinct, connected_components(links(distinct)))


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    Documents link where their fingerprints differ in at most 2 bits; component_id
    is the smallest doc_id that links reach. Null texts have fingerprint zero and
    link like any other; a null doc_id never becomes a component_id unless its
    component has no other; repeated rows give repeated rows; an empty table gives
    none; other columns are ignored; very long texts are hashed in chunks, whole.
    Exact copies collapse to one fingerprint before any pair is sought, and every
    join back is by fingerprint, so that Spark can split a hot one."""
    own = checkpointed(fingerprints(docs, shingle))
    roots = _roots(own)
    first = own.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    least = checkpointed(first.join(roots, first.fp == roots.class_fp).groupBy("root").agg(F.min("first_id").alias("component_id")))
    classes = roots.join(least, "root").select("class_fp", "component_id")
    return own.join(classes, own.fp == classes.class_fp).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
