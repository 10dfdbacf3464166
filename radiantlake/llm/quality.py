"""Quality rules for documents and, with an empirical beta prior, for their hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, checkpointed

SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Documents that fail more often than so much of the time, after shrinkage, take their whole host with them.
MAX_HOST_RATE = 0.5
#: Hosts (about 50 bytes each) that are broadcast at most; more are joined by shuffle.
BROADCAST_HOSTS = 200_000


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def features(docs: DataFrame) -> DataFrame:
    """docs' rows as the struct _row, and beside it doc_id, source and the counts that rules use.

    n_repeat_words: 3-word windows are 64 bit hashes. They are sorted with their place
    in the low bits (as many as the text needs), so that equal windows are neighbours;
    neighbours are then compared by their whole hashes, and the words under repeated
    windows are counted from the sorted places."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(F.struct("*").alias("_row"), "doc_id", "source", text.alias("_text"))
    step = step.withColumn("_words", F.when(F.char_length(F.btrim("_text", F.lit(SPACE))) > 0, F.split(F.btrim("_text", F.lit(SPACE)), SPACES)).otherwise(F.array().cast("array<string>")))
    step = step.withColumn("_hashes", F.expr("if(size(_words) < 3, cast(array() as array<bigint>), transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])))"))
    step = step.withColumn("_mask", F.expr("shiftleft(1L, cast(ceil(log2(size(_words) + 2)) as int)) - 1"))
    step = step.withColumn("_order", F.expr("sort_array(transform(_hashes, (h, i) -> (h & ~_mask) | i))"))
    same = "((x ^ _order[{0}]) between 0 and _mask and _hashes[cast(x & _mask as int)] = _hashes[cast(_order[{0}] & _mask as int)])"
    step = step.withColumn("_places", F.expr(f"sort_array(transform(filter(_order, (x, j) -> (j > 0 and {same.format('j - 1')}) or (j < size(_order) - 1 and {same.format('j + 1')})), x -> x & _mask))"))
    step = step.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: F.char_length(_without(x, SPACE)) > 0))
    chars = F.char_length("_text")
    return step.select(
        "_row",
        "doc_id",
        "source",
        F.size("_words").cast("bigint").alias("n_words"),
        F.char_length(_without(F.col("_text"), SPACE)).cast("bigint").alias("word_chars"),
        (chars - F.char_length(_without(F.col("_text"), SYMBOLS))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr("aggregate(transform(_places, (p, k) -> if(k = 0, 3L, least(3L, p - _places[k - 1]))), 0L, (a, x) -> a + x)").alias("n_repeat_words"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (chars - F.char_length(_without(F.col("_text"), CAPITALS))).cast("bigint").alias("n_capitals"),
    )


def rules(rows: DataFrame) -> DataFrame:
    """Adds base_failed (few words, or mostly repeated ones) and doc_failed (that, or
    mostly symbols, repeated lines, capitals)."""
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    own = F.expr("10 * n_symbols > 3 * n_words or 100 * n_dup_lines > 35 * n_lines or 2 * n_capitals > word_chars")
    return rows.withColumn("base_failed", base).withColumn("doc_failed", F.col("base_failed") | own)


def host_verdicts(rows: DataFrame) -> DataFrame:
    """host, host_rate, host_failed from rows of source and doc_failed.

    Rates are shrunk with a beta prior that has the mean of all documents and, by
    moments, the spread of the hosts' rates beyond what their sizes explain; between
    2 and a million documents' weight. Null sources are one host."""
    hosts = rows.groupBy(F.col("source").alias("host")).agg(F.count("*").alias("n"), F.sum(F.col("doc_failed").cast("bigint")).alias("failed"))
    hosts = checkpointed(hosts)
    prior = hosts.agg((F.sum("failed") / F.sum("n")).alias("mean"), F.var_pop(F.col("failed") / F.col("n")).alias("spread"), F.avg(1 / F.col("n")).alias("noise")).first()
    mean = prior["mean"] or 0.0
    within = mean * (1 - mean)
    between = max(0.0, (prior["spread"] or 0.0) - within * (prior["noise"] or 0.0))
    weight = min(1e6, max(2.0, within / between - 1)) if between > 0 else 1e6
    rate = (F.col("failed") + mean * weight) / (F.col("n") + weight)
    return hosts.select("host", rate.alias("host_rate"), (rate > MAX_HOST_RATE).alias("host_failed"))


def _with_hosts(rows: DataFrame) -> DataFrame:
    """rows with host_failed and kept.

    Failures are counted by host (combined map-side, so a hot host costs a row for
    each task), and host verdicts come back by a broadcast join while hosts are few,
    by a shuffle join with skew handling beyond. A document is kept if neither it
    nor its host failed."""
    hosts = host_verdicts(rows.select("source", "doc_failed"))
    if bounded(hosts, BROADCAST_HOSTS):
        hosts = F.broadcast(hosts)
    joined = rows.join(hosts, rows.source.eqNullSafe(hosts.host), "left")
    return joined.withColumn("kept", ~(F.col("doc_failed") | F.coalesce("host_failed", F.lit(False))))


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every row.

    Null text has no words and fails; null sources are one host; null doc_ids and
    repeated rows stay; an empty table gives no rows; columns beyond doc_id, text
    and source are ignored. Counts take time n log n in a text, whatever its length."""
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    rows = checkpointed(rules(features(docs.select("doc_id", "text", "source"))).drop("_row"))
    return _with_hosts(rows).select(*names, "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns.

    A text is judged once: what its own rules keep is checkpointed whole, of other rows
    only the source, and the hosts' verdicts then meet what is left.

    Null and empty texts go; null sources are one host; repeated rows stay or go
    together; very long texts are judged whole; an empty table gives no rows; columns of
    any name are kept."""
    rows = rules(features(docs)).select("source", "doc_failed", F.when(~F.col("doc_failed"), F.col("_row")).alias("_row"))
    rows = _with_hosts(checkpointed(rows)).where(F.col("kept")).select("_row")
    return rows.select("_row.*")
