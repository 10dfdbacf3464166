"""Secret scans over an incremental ledger of blobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, checkpointed

RULES_VERSION = "base-1"
KINDS = ("assign", "access", "hex")
# Begin, end and middle of a match in a marked text; the text's own are replaced by FREE first, which no rule matches.
BEGIN, END, MIDDLE, FREE = "\x01", "\x02", "\x03", "\x04"
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
# Leftmost runs of at least the least length are what is left of all runs when short ones are dropped.
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
NONE = "cast(array() as array<struct<start:int,rank:int,kind:string,end:int>>)"
#: Documents with findings (about 300 bytes each) that are broadcast at most when texts are redacted.
BROADCAST_FINDINGS = 100_000


def _spans(text: str, kind: str) -> Column:
    """(start, rank, kind, end) of one kind's matches in the column text, in code points.

    Matches are marked by a replacement, the text is split at the marks, and the
    lengths of the parts add up to the places. Texts without a match skip all that."""
    rank = KINDS.index(kind)
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}[kind]
    to = f"{BEGIN}$1{MIDDLE}$2{END}" if kind == "assign" else f"{BEGIN}$0{END}"
    free = F.translate(F.col(text), BEGIN + END + MIDDLE, FREE * 3)
    parts = F.split(F.regexp_replace(free, pattern, to), BEGIN)
    kind_type = "struct<start:int,rank:int,kind:string,end:int>"

    def add(acc: Column, part: Column) -> Column:
        match = F.substring_index(part, END, 1)
        n = F.char_length(match) - (1 if kind == "assign" else 0)
        value = F.char_length(F.substring_index(match, MIDDLE, -1)) if kind == "assign" else n
        span = F.struct(acc["at"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (acc["at"] + n).cast("int").alias("end"))
        spans = F.when(value >= LEAST[kind], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((acc["at"] + F.char_length(part) - (2 if kind == "assign" else 1)).cast("int").alias("at"), spans.alias("spans"))

    start = F.struct(F.char_length(F.element_at("_parts", 1)).cast("int").alias("at"), F.array().cast(f"array<{kind_type}>").alias("spans"))
    return parts, start, add


def scan(blobs: DataFrame, version: str = RULES_VERSION) -> DataFrame:
    """blob, rules_version, n_assign, n_access, n_hex, found (spans by start, then kind)
    for rows of blob, text. Regular expressions run once over a text; positions are
    worked out only in texts with a match."""
    out = blobs.select("blob", "text")
    names = []
    for kind in KINDS:
        parts, start, add = _spans("text", kind)
        out = out.withColumn("_parts", parts)
        spans = F.when(F.size("_parts") > 1, F.aggregate(F.slice("_parts", 2, F.size("_parts")), start, add)["spans"]).otherwise(F.expr(NONE))
        out = out.withColumn(f"_{kind}", spans).drop("_parts")
        names.append(f"_{kind}")
    return out.select("blob", F.lit(version).alias("rules_version"), *(F.size(n).cast("bigint").alias(f"n{n}") for n in names), F.array_sort(F.concat(*names)).alias("found"))


def address(docs: DataFrame) -> Column:
    """The content address of a text; null is empty."""
    return F.sha2(F.coalesce(docs.text, F.lit("")), 256)


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULES_VERSION) -> DataFrame:
    """Ledger rows for those blobs of docs that ledger has not with this rules version.

    Equal texts are one blob: copies are combined map-side before the shuffle by
    address, so a hot text costs one row a task, and is scanned once."""
    blobs = docs.select(address(docs).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.where(F.col("rules_version") == version).select("blob"), "blob", "left_anti")
    return scan(blobs, version)


def extend(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULES_VERSION) -> DataFrame:
    """ledger with what docs add to it, checkpointed in the shared folder."""
    new = checkpointed(scan_new(docs, ledger, version))
    return new if ledger is None else ledger.unionByName(new)


def stored_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger in a folder; None if nothing has been written there."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.parquet(path) if there else None


def extend_stored(docs: DataFrame, path: str, version: str = RULES_VERSION) -> DataFrame:
    """The ledger in a folder, with what docs add to it written there first.

    Only blobs that it has not with this rules version are scanned and appended, so
    the next snapshot, of any documents, finds them; rows of other versions stay. One
    writer at a time."""
    spark = docs.sparkSession
    scan_new(docs, stored_ledger(spark, path), version).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def findings(docs: DataFrame, ledger: DataFrame | None = None, version: str = RULES_VERSION, path: str | None = None, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keys, n_assign, n_access, n_hex, base_sha256, spans, blob for every row of docs.

    docs may hold one snapshot or all historical versions, a row each; keys name what
    says where a version was (a document, a path and a revision). The ledger, a table
    or with path a folder, is extended by docs' unseen blobs and joined back to all
    rows that hold a blob; so a text is scanned once for each rules version, however
    many rows and snapshots have it.

    Null text is the empty blob; null keys and repeated rows stay; spans at one place
    are ordered by kind; a very long text is scanned whole; an empty table gives no
    rows; other columns are ignored. The method finds each blob once and adds no kinds
    of its own, so all spans are base spans."""
    book = extend(docs, ledger, version) if path is None else extend_stored(docs, path, version)
    book = book.where(F.col("rules_version") == version).withColumnRenamed("blob", "_blob")
    paths = docs.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), address(docs).alias("blob"))
    text = _joined(F.col("found"))
    rows = paths.join(book, paths.blob == book._blob)
    return rows.select(*(F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)), "n_assign", "n_access", "n_hex", F.sha2(text, 256).alias("base_sha256"), text.alias("spans"), "blob")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every secret replaced by mark and n_chars counted anew; all rows and columns stay.

    Overlapping spans are replaced together. Null and empty texts stay as they are, as
    do repeated rows and columns of any name; a very long text is scanned whole; an empty
    table gives no rows. Only blobs with findings meet the texts
    again, broadcast while they are few."""
    book = extend(docs).where(F.size("found") > 0).select(F.col("blob").alias("_blob"), "found")
    if bounded(book, BROADCAST_FINDINGS):
        book = F.broadcast(book)
    rows = docs.select(F.struct("*").alias("_row"), "text", address(docs).alias("_address"))
    rows = rows.join(book, rows._address == book._blob, "left")
    text_type = "struct<text:string,at:int>"
    whole = F.col("text")

    def cut(acc: Column, s: Column) -> Column:
        before = F.concat(acc["text"], F.when(s["start"] >= acc["at"], F.concat(F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(F.lit("")))
        return F.struct(before.alias("text"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate("found", F.struct(F.lit("").alias("text"), F.lit(0).alias("at")).cast(text_type), cut, lambda a: F.concat(a["text"], F.substring(whole, a["at"] + 1, F.char_length(whole))))
    clean = F.when(F.col("_blob").isNotNull(), done).otherwise(whole)
    rows = rows.select("_row", clean.alias("_clean"))
    names = docs.columns
    fresh = {"text": F.col("_clean")} | ({"n_chars": F.coalesce(F.char_length("_clean").cast(docs.schema["n_chars"].dataType), F.col("_row.n_chars"))} if "n_chars" in names else {})
    return rows.select(*(fresh.get(c, F.col("_row")[c]).alias(c) for c in names))
