"""Benchmark decontamination by canonical templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpointed

#: Tokens of a window.
WINDOW = 5
#: An item with fewer tokens than a window matches by all its words; one with fewer than these can't be told from prose.
LEAST_WORDS = 3
#: Windows of an item that a document must hold, as a share.
COVERAGE = 0.5
#: Slots of an item that must map to one value each, as a share of its matched slots: all.
CONSISTENT = 1.0
#: Benchmark windows (about 100 bytes each) that are broadcast at most; more are joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Contaminated documents (about 50 bytes each) that are broadcast at most when documents are filtered.
BROADCAST_DOCS = 200_000

UNITS = "kg|g|mg|lb|lbs|oz|km|m|cm|mm|mile|miles|feet|foot|ft|inch|inches|yard|yards|liter|liters|litre|litres|ml|l|gallon|gallons|second|seconds|minute|minutes|min|hour|hours|day|days|week|weeks|month|months|year|years|dollar|dollars|cent|cents|euro|euros|percent|degree|degrees|mph|kmh|watt|watts|volt|volts|byte|bytes|kb|mb|gb"
NUMBER = r"(?<![\p{L}\p{N}])(\d++(?:[.,:/]\d++)*+)"
# A name: a capitalised word inside a sentence. Slot words begin with 0 and are one token.
NAME = r"(?<=[\p{Ll}\d,;][ \n])\p{Lu}\p{Ll}+"


def slot_words(text: Column) -> Column:
    """The text's words, lower-cased and without punctuation; numbers, names and units
    as 0num..., 0name..., 0unit... with what they stand for."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), NAME, "0name$0")
    s = F.lower(s)
    s = F.regexp_replace(s, NUMBER + rf"\s*({UNITS})(?![\p{{L}}\p{{N}}])", "0num$1 0unit$2")
    s = F.regexp_replace(s, NUMBER + r"(?![\p{L}\p{N}])", "0num$1")
    s = F.regexp_replace(s, r"[^\p{L}\p{N}\s]++", "")
    return F.split(F.btrim(s, F.lit(" \t\n\x0b\x0c\r")), r"\s+")


def windows(table: DataFrame, keep: list[str], n: int, short: list[int], whole: bool = False) -> DataFrame:
    """keep and, for each window of n words: h (hash of its template), at (its place),
    slots (its slot words), and of the text: n_windows. Beside these, windows of each
    number of words in short, by the words as they stand; with whole, only those of
    whole texts.

    The template of a slot word is its type alone. A window of slots alone says nothing
    as a template; there h is of the words with their values. A text's words are hashed in the
    place where they are split, so what is exploded is a hash, a place and, only
    where a window has some, slot words. Whether a text is long enough is asked inside
    what is exploded: a filter would be pushed below the words and make them twice."""
    words = table.select(*keep, slot_words(F.col("text")).alias("_w"))
    words = words.withColumn("_has", F.exists("_w", lambda w: w.startswith("0n") | w.startswith("0u")))
    typed = F.transform("_w", lambda w: F.when(w.startswith("0num"), F.lit("0num")).when(w.startswith("0name"), F.lit("0name")).when(w.startswith("0unit"), F.lit("0unit")).otherwise(w))
    words = words.withColumn("_t", F.when(F.col("_has"), typed).otherwise(F.col("_w")))
    none = F.array().cast("array<string>")
    slots = lambda i: F.filter(F.slice("_w", i + 1, n), lambda w: w.startswith("0num") | w.startswith("0name") | w.startswith("0unit"))
    each = F.transform(F.sequence(F.lit(0), F.size("_t") - n), lambda i: F.struct(F.when(F.col("_has") & F.get("_t", i).isin("0num", "0name", "0unit") & (F.size(slots(i)) == n), F.xxhash64(F.slice("_w", i + 1, n))).otherwise(F.xxhash64(F.slice("_t", i + 1, n))).alias("h"), i.alias("at"), F.when(F.col("_has"), slots(i)).otherwise(none).alias("slots")))
    found = F.when(F.size("_t") >= n, each)
    if short:
        words = words.withColumn("_plain", F.transform("_w", lambda w: F.regexp_replace(w, "^0(num|name|unit)", "")))

    def runs(m: int) -> Column:
        size = F.size("_plain")
        row = lambda i: F.struct(F.xxhash64(F.slice("_plain", i + 1, m)).alias("h"), i.alias("at"), none.alias("slots"))
        return F.when(size == m if whole else size >= m, F.transform(F.sequence(F.lit(0), size - m), row))

    for m in short:
        found = F.coalesce(F.concat(found, runs(m)), found, runs(m))
    return words.select(*keep, F.greatest(F.size("_t") - n + 1, F.lit(1)).alias("n_windows"), F.explode(found).alias("_x")).select(*keep, "n_windows", "_x.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, coverage: float = COVERAGE, consistent: float = CONSISTENT) -> DataFrame:
    """doc_id, text_key, item_id, n_hits, n_windows, coverage, n_slots, n_changed for every
    document and benchmark item found in it; clean documents have no row.

    Windows of canonical templates are hash-joined; the benchmark's are broadcast up
    to BROADCAST_WINDOWS, so documents are scanned once and not shuffled, and only
    hits are. An item counts as found where the document holds at least coverage of
    its windows, and where its slots (numbers, names, units) map to one value each,
    at one alignment, for at least consistent of them: a re-parameterised question
    changes its values alike throughout.

    An item of LEAST_WORDS to n - 1 words is found where a document has all its words,
    values included, in a row; shorter ones never are.

    text_key is a hash of the text, so documents that share a doc_id, or have none,
    stay apart. Null and empty texts never match; repeated rows are one; a document that
    holds several items has a row for each; very long texts are read whole, a row for
    each of their hits; empty tables give no rows; other columns are ignored."""
    lengths = benchmark.select(F.size(slot_words(F.col("text"))).alias("m")).distinct().where(F.col("m").between(LEAST_WORDS, n - 1))
    short = sorted(r.m for r in lengths.collect())  # n - LEAST_WORDS values at most
    own = windows(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")), ["doc_id", "text_key"], n, short).drop("n_windows")
    items = windows(benchmark.select("item_id", "text"), ["item_id"], n, short, whole=True)
    items = items.select("item_id", "n_windows", F.col("h").alias("i_h"), F.col("at").alias("i_at"), F.col("slots").alias("i_slots"))
    if bounded(items, BROADCAST_WINDOWS):
        items = F.broadcast(items)
    hits = own.join(items, own.h == items.i_h)
    pairs = F.arrays_zip("i_slots", "slots")
    by = ["doc_id", "text_key", "item_id"]
    # one row an alignment: its places, and what its slots map to
    aligned = hits.groupBy(*by, "n_windows", (F.col("at") - F.col("i_at")).alias("shift")).agg(F.collect_set("i_at").alias("places"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("maps"))
    values = F.array_distinct(F.transform("maps", lambda p: p["i_slots"]))
    aligned = aligned.withColumn("n_slots", F.size(values)).withColumn("n_changed", F.size(F.filter(values, lambda v: F.size(F.filter("maps", lambda p: p["i_slots"] == v)) > 1)))
    aligned = aligned.where((F.col("n_slots") == 0) | (F.col("n_slots") - F.col("n_changed") >= consistent * F.col("n_slots")))
    found = aligned.groupBy(*by, "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_hits"), F.sum("n_slots").alias("n_slots"), F.sum("n_changed").alias("n_changed"))
    return found.where(F.col("n_hits") >= coverage * F.col("n_windows")).select(*by, F.col("n_hits").cast("bigint").alias("n_hits"), F.col("n_windows").cast("bigint").alias("n_windows"), (F.col("n_hits") / F.col("n_windows")).alias("coverage"), "n_slots", "n_changed")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found, with all their columns.

    Null and empty texts stay; equal documents stay or go together; an empty table gives
    no rows, and without a benchmark all stay; columns of any name are kept."""
    bad = checkpointed(contaminated(docs, benchmark).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct())
    if bounded(bad, BROADCAST_DOCS):
        bad = F.broadcast(bad)
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", F.xxhash64("text").alias("text_key"))
    return rows.join(bad, (rows.text_key == bad._key) & rows.doc_id.eqNullSafe(bad._id), "left_anti").select("_row.*")
