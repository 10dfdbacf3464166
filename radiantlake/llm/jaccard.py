"""Exact links between texts by the similarity of their word shingles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import bounded, checkpointed, map_columns, steps
from .components import connected_components

#: Words of a shingle, and the least Jaccard similarity of linked texts as a fraction.
SHINGLE = 5
SIMILARITY = (4, 5)
#: Places that the shingles of all texts are counted in, and places of a row of counts.
PLACES, STRETCH = 1 << 22, 1 << 14
#: Texts (8 bytes each) whose shingles are asked for by a broadcast at most.
BROADCAST_TEXTS = 200_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes (64 bits, signed) of a whole text's shingles.

    Words are those of the fingerprints: A-Z lower-cased, runs of anything but ASCII
    white space. Fewer words than a shingle: the whole sequence is the one shingle,
    also where there is no word at all."""
    import xxhash

    words = (text or "").encode().lower().split()
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42 + len(words))], dtype=np.uint64).view(np.int64)
    hash64 = xxhash.xxh64_intdigest
    known: dict[bytes, int] = {}
    h = np.array([known[w] if w in known else known.setdefault(w, hash64(w, 42)) for w in words], dtype=np.uint64)
    n = len(h) - size + 1
    x = _mixed(h[:n] + _M1)
    for k in range(1, size):
        x = _mixed(x * _M1 + h[k : k + n])
    return np.unique(x.view(np.int64))


def _set_hash(own: np.ndarray) -> int:
    import xxhash

    x = xxhash.xxh64_intdigest(own.tobytes())
    return x - (1 << 64) if x >> 63 else x


def sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """fp (a hash of the set), own (the shingles) for every row of docs."""

    def factory():
        def step(cols):
            own = [shingles(t, size) for t in cols["text"]]
            return {"fp": [_set_hash(x) for x in own], "own": own}

        return step

    return map_columns(docs.select("text"), factory, "fp bigint, own array<bigint>")


def places(own: np.ndarray) -> np.ndarray:
    """The place of each shingle among PLACES."""
    return (_mixed(own.view(np.uint64) ^ _M2) >> np.uint64(65 - PLACES.bit_length())).astype(np.int64)


def ranks(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes: four steps to a doubling, so no size of the input runs out of them."""
    return np.floor(4 * np.log2(counts + 1)).astype(np.uint8)


def shingle_ranks(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """The rank of each place: how often its shingles come in all texts.

    Every text is counted. A task adds up its own texts and hands on a row for each
    stretch of places; rows of a stretch are added up one after the other. So the
    shuffle is bounded by the number of tasks, a worker holds one count for each
    place, and the driver gets PLACES bytes, at any size. Shingles that meet in a place
    share its rank; that is only an order, and links never depend on it."""
    import zlib

    import pyarrow as pa

    def count(batches):
        counts = np.zeros(PLACES, dtype=np.int64)
        for batch in (x for whole in batches for x in steps(whole)):
            for text in batch.column(0).to_pylist():
                np.add.at(counts, places(shingles(text, size)), 1)
        for at in range(PLACES // STRETCH):
            part = counts[at * STRETCH : (at + 1) * STRETCH]
            if most := part.max():
                packed = zlib.compress(part.astype(np.uint8 if most < 256 else np.int64).tobytes(), 1)
                yield pa.RecordBatch.from_pydict({"stretch": pa.array([at], pa.int32()), "part": pa.array([packed], pa.binary())})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = zlib.decompress(packed)
                part = np.frombuffer(raw, dtype=np.uint8 if len(raw) == STRETCH else np.int64)
                sums.setdefault(at, np.zeros(STRETCH, dtype=np.int64))
                sums[at] += part
        for at, total in sums.items():
            yield pa.RecordBatch.from_pydict({"stretch": pa.array([at], pa.int32()), "part": pa.array([ranks(total).tobytes()], pa.binary())})

    schema = "stretch int, part binary"
    out = np.zeros(PLACES, dtype=np.uint8)
    for row in docs.select("text").mapInArrow(count, schema).repartition("stretch").mapInArrow(add, schema).collect():  # PLACES / STRETCH rows
        out[row.stretch * STRETCH : (row.stretch + 1) * STRETCH] = np.frombuffer(bytes(row.part), dtype=np.uint8)
    return out


def parities(own: np.ndarray, width: int) -> np.ndarray:
    """For each of width places, whether an odd number of the shingles falls there, as longs.

    Two sets' places differ in no more than the shingles that one of them has alone."""
    odd = np.bincount((_mixed(own.view(np.uint64)) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def parity_width(n: int) -> int:
    """Places for n shingles: 128 to 4096, at least n where that allows; sets that may link differ by one step at most."""
    return min(4096, max(128, 1 << (n - 1).bit_length()))


def prefixes(docs: DataFrame, size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """doc_id, text_hash, fp, n (shingles), sim (the shingles' SimHash), odd and odd_half
    (parities at the set's width and at half of it) and prefix for every row of docs.

    All sets are ordered alike, rarest places first. Sets at the similarity or above
    share one of their first n - ceil(similarity * n) + 1 shingles, the prefix."""
    p, q = similarity
    ranked = docs.sparkSession.sparkContext.broadcast(shingle_ranks(docs, size))

    def factory():
        rank = ranked.value

        def step(cols):
            out = {"doc_id": cols["doc_id"], "text_hash": cols["text_hash"]} | {k: [] for k in ("fp", "n", "sim", "odd", "odd_half", "prefix")}
            for text in cols["text"]:
                own = shingles(text, size)
                n = len(own)
                width = parity_width(n)
                sim = simhash.majority(sum(simhash.bit_counts(own[at : at + simhash.CHUNK].view(np.uint64)) for at in range(0, n, simhash.CHUNK)), n)
                first = own[np.argsort(rank[places(own)], kind="stable")]
                for name, v in (("fp", _set_hash(own)), ("n", n), ("sim", simhash.signed(sim)), ("odd", parities(own, width)), ("odd_half", parities(own, width // 2)), ("prefix", first[: n - -(-p * n // q) + 1])):
                    out[name].append(v)
            return out

        return step

    return map_columns(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), factory, "doc_id bigint, text_hash bigint, fp bigint, n int, sim bigint, odd array<bigint>, odd_half array<bigint>, prefix array<bigint>")


def _can(a_n, a_at, b_n, b_at, similarity: tuple[int, int]):
    """Whether sets of such sizes may be at the similarity if what they share begins at these places.

    A pair meets in every bucket of a shared prefix shingle; in that of the first one this misses none."""
    p, q = similarity
    return F.least(a_n - a_at, b_n - b_at).cast("bigint") * (p + q) >= (a_n + b_n).cast("bigint") * p


def _may(a: str, b: str, similarity: tuple[int, int]):
    """Whether the parities of sets a and b allow the similarity: what one of two linked sets has alone is bounded by their sizes."""
    p, q = similarity

    def apart(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, k: s + k)

    wide, other = F.size(f"{a}.odd"), F.size(f"{b}.odd")
    least = F.when(wide == other, apart(f"{a}.odd", f"{b}.odd")).when(wide < other, apart(f"{a}.odd", f"{b}.odd_half")).otherwise(apart(f"{a}.odd_half", f"{b}.odd"))
    return least.cast("bigint") * (p + q) <= (F.col(f"{a}.n") + F.col(f"{b}.n")).cast("bigint") * (q - p)


def verified(pairs: DataFrame, docs: DataFrame, texts: DataFrame, parts: int, similarity: tuple[int, int] = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """The pairs a, b whose whole sets are at the similarity or above; repeated rows of docs may repeat them.

    texts has, of each fp, n, the parities, and hash and id of one row. Parities turn
    most other pairs away; of what is left the shingles are made anew, from those rows."""
    p, q = similarity
    x, y = texts.alias("x"), texts.alias("y")
    some = pairs.join(x, F.col("a") == F.col("x.fp")).join(y, F.col("b") == F.col("y.fp")).where((F.least("x.n", "y.n") * q >= F.greatest("x.n", "y.n") * p) & _may("x", "y", similarity))
    some = checkpointed(some.select("a", "b", F.col("x.row").alias("a_row"), F.col("y.row").alias("b_row")).coalesce(parts))

    def side(c: str) -> DataFrame:
        """Sets of one side's texts; those of the first are few, so most sets are made and moved once."""
        ends = checkpointed(some.select(f"{c}_row.text_hash", f"{c}_row.doc_id").distinct().toDF("_hash", "_id").coalesce(parts))
        if bounded(ends, BROADCAST_TEXTS):
            ends = F.broadcast(ends)
        whole = docs.select("text", "doc_id", F.xxhash64("text").alias("_own")).join(ends, (F.col("_own") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        return sets(whole, size).select(F.col("fp").alias(c), F.col("own").alias(f"{c}_own"))

    left, right = side("a"), side("b")
    shared = F.size(F.array_intersect("a_own", "b_own"))
    return some.select("a", "b").join(left, "a").join(right, "b").where(shared * (p + q) >= (F.size("a_own") + F.size("b_own")) * p).select("a", "b")


def _joined(named: DataFrame, pairs: DataFrame, parts: int) -> DataFrame:
    """class_fp, root, many (the members of the root): named, with the roots of linked pairs a, b made one."""
    for c in "ab":
        pairs = pairs.join(named.select(F.col("class_fp").alias(c), F.col("root").alias(f"{c}_root")), c)
    tops = connected_components(pairs.select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))).select("node", F.col("root").alias("top"))
    again = checkpointed(named.select("class_fp", "root").join(tops, F.col("root") == F.col("node"), "left").select("class_fp", F.coalesce("top", "root").alias("root")).coalesce(parts))
    sizes = checkpointed(again.groupBy("root").agg(F.count("*").alias("many")).coalesce(parts))
    return checkpointed(again.join(sizes, "root").select("class_fp", "root", "many").coalesce(parts))


def _close(texts: DataFrame) -> DataFrame:
    """a, b: each set beside the first of its fingerprint, and the first ones of fingerprints that link."""
    firsts = checkpointed(texts.groupBy(F.col("sim").alias("of")).agg(F.min("fp").alias("a")))
    same = texts.join(firsts, F.col("sim") == F.col("of")).select("a", F.col("fp").alias("b")).where("a <> b")
    near = simhash.links(firsts.select(F.col("of").alias("fp")))
    for c in "ab":
        near = near.join(firsts.select(F.col("of").alias(c), F.col("a").alias(f"{c}_first")), c)
    return same.union(near.select("a_first", "b_first"))


#: Rounds in which sets are compared with one of the largest group in their bucket, before all that are apart are.
ROUNDS = 1
#: Sets in a partition at least, where only ids and sizes of sets are held.
PART_SETS = 50_000


def roots(own: DataFrame, docs: DataFrame, similarity: tuple[int, int] = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """class_fp, root for every fp of own (see prefixes); equal roots are linked by pairs at the similarity.

    Verified first are the pairs that multi-index hashing of fingerprints finds, and
    each set beside the first one, in an order of all, of every bucket of its prefix
    shingles. Then, for some rounds, each is verified against one member of the largest
    group in its bucket. That joins most of a family of copies at no more than a row for
    each member and bucket. At last all pairs of a bucket that are still apart, and that
    sizes, places and parities allow, are verified, so each link is decided."""
    texts = own.groupBy("fp").agg(F.min(F.struct("text_hash", "doc_id")).alias("row"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("odd").alias("odd"), F.first("odd_half").alias("odd_half"))
    texts = checkpointed(texts)
    parts = 1 + texts.count() // PART_SETS
    texts = texts.coalesce(parts)
    key = Window.partitionBy("key")

    def tied(rows: DataFrame) -> DataFrame:
        """a, b: each row's set beside the one that leads its bucket."""
        rows = rows.where((F.col("fp") != F.col("lead.fp")) & _can(F.col("n"), F.col("at"), F.col("lead.n"), F.col("lead.at"), similarity))
        return rows.select(F.col("lead.fp").alias("a"), F.col("fp").alias("b"))

    each = own.select("fp", "n", "prefix").dropDuplicates(["fp"]).select("fp", "n", F.posexplode("prefix").alias("at", "key"))
    lead = F.min(F.struct(F.xxhash64("fp").alias("by"), "fp", "n", "at")).over(key)
    members = checkpointed(each.withColumn("met", F.count("*").over(key)).withColumn("lead", lead).where("met > 1"))
    pairs = checkpointed(tied(members).union(_close(texts)).distinct().coalesce(parts))
    named = texts.select(F.col("fp").alias("class_fp"), F.col("fp").alias("root"))
    named = _joined(named, verified(pairs, docs, texts, parts, similarity, size), parts)

    # a bucket of two has no pair but that one
    members = members.where("met > 2").select("key", "fp", "n", "at")

    def apart() -> DataFrame:
        """Members of buckets that hold more than one root, with root and group size."""
        rows = members.join(named, F.col("fp") == F.col("class_fp")).drop("class_fp")
        rows = rows.withColumn("low", F.min("root").over(key)).withColumn("high", F.max("root").over(key))
        return rows.where("low <> high").drop("low", "high")

    for k in range(ROUNDS):
        lead = F.max(F.struct("many", F.xxhash64("root").alias("by"), F.xxhash64("fp", F.lit(k)).alias("of"), "fp", "n", "at", "root")).over(key)
        ties = checkpointed(tied(apart().withColumn("lead", lead).where(F.col("root") != F.col("lead.root"))).distinct().coalesce(parts))
        named = _joined(named, verified(ties, docs, texts, parts, similarity, size), parts)

    members = checkpointed(apart().drop("many")).join(texts.select("fp", "odd", "odd_half"), "fp")
    x, y = members.alias("x"), members.alias("y")
    both = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.root") != F.col("y.root")) & _can(F.col("x.n"), F.col("x.at"), F.col("y.n"), F.col("y.at"), similarity) & _may("x", "y", similarity))
    rest = checkpointed(both.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct().coalesce(parts))
    return _joined(named, verified(rest, docs, texts, parts, similarity, size), parts).select("class_fp", "root")
