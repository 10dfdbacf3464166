"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines of the cluster share: the session's spark.checkpoint.dir.

    A session on one machine may have none and gets a temporary one; on a cluster it has to be set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and context.master.startswith("local") and "cluster" not in context.master:
            where = tempfile.mkdtemp(prefix="checkpoint-")
        if not where:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(where)
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path within the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a reliable checkpoint in the folder that the cluster shares."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of one column that a worker's step gets at once; a longer single value comes alone.
STEP_BYTES = 8 << 20


def steps(batch: pa.RecordBatch):
    """Slices of a batch (Spark ends it at 64 MB) of about STEP_BYTES, so that many long texts in a row do not meet in memory as Python objects."""
    rows = batch.num_rows
    parts = max(1, min(rows, -(-batch.nbytes // STEP_BYTES)))
    for k in range(parts):
        low, high = rows * k // parts, rows * (k + 1) // parts
        if high > low:
            yield batch.slice(low, high - low)


def map_columns(df: DataFrame, factory, schema: str) -> DataFrame:
    """Map column batches. factory() runs once a task and returns a function from
    {input column: list} to {output column: list}; rows never cross tasks."""
    struct = T._parse_datatype_string(schema)
    arrow = to_arrow_schema(struct)
    names = df.columns

    def run(batches):
        step = factory()
        for batch in (x for whole in batches for x in steps(whole)):
            out = step({name: batch.column(i).to_pylist() for i, name in enumerate(names)})
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, struct)


def spans_text(spans: list[tuple[int, int, str, int]]) -> str:
    """kind:start:end joined by commas, of (start, kind rank, kind, end)."""
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


def bounded(df: DataFrame, most: int) -> bool:
    """Whether df has at most so many rows; reads no more than one row beyond."""
    return df.limit(most + 1).count() <= most


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
