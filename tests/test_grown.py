"""File queries over a table that is dealt to several tasks, exactly as their SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from radiantlake import catalog
from radiantlake.operators import attributes, ordering
from radiantlake.plans import codecs

ROWS = 20_000


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """A folder with embeddings alone, their ids in no order."""
    rng = np.random.default_rng(11)
    folder = tmp_path_factory.mktemp("grown")
    rows = {"vec_id": rng.permutation(ROWS) * 3, "label": rng.integers(0, 10, ROWS), "embedding": list((rng.standard_normal((ROWS, 64)) / 8).astype(np.float32))}
    pd.DataFrame(rows).to_parquet(folder / "embeddings.parquet")
    return str(folder)


@pytest.fixture
def narrow(spark):
    """Small partitions are not put together, as they are not where tables are large."""
    name = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(name, "4k")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("name", ["coded_file", "point_file", "primitive_file"])
def test_file_is_exact(spark, grown, narrow, name):
    df = catalog.QUERIES[name](spark, grown)
    got = sorted(map(tuple, df.collect()))
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{grown}/embeddings.parquet'")
    want = sorted(c.sql(f"select {', '.join(df.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall())
    assert len(got) == ROWS and got == want


@pytest.mark.parametrize("cell_rows", [1, 7, 1000, ordering.CELL_ROWS])
def test_numbers_have_no_gaps(spark, narrow, cell_rows):
    """Many equal first keys, nulls, and keys that fall together entirely."""
    n = 3000 if cell_rows < 100 else 30_000
    first = F.when(F.col("id") % 11 > 0, F.floor(F.sqrt((F.col("id") * 7919 % n).cast("double"))))
    df = spark.range(n).select(first.alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 100).cast("string").alias("b"), F.repeat(F.lit("x"), 50).alias("wide"))
    got = ordering.numbered(df, ["a", "b"], cell_rows=cell_rows).collect()
    assert sorted(r.ordinal for r in got) == list(range(n))
    keys = [(r.a is not None, r.a or 0, r.b is not None, r.b or "") for r in sorted(got, key=lambda r: r.ordinal)]
    assert keys == sorted(keys)
    none = ordering.numbered(df.where("a < 0"), ["a"], cell_rows=cell_rows)
    assert none.count() == 0 and none.schema["ordinal"].dataType.simpleString() == "bigint"


@pytest.mark.parametrize("bits", [2, 3, 4, 5])
def test_containers_by_blocks(spark, grown, monkeypatch, bits):
    """Blocks and stretches that end anywhere change no byte and no row; a table may be empty."""
    options = codecs.Options(sh_bits=bits, sh_degree=1)
    coded = codecs.compress(attributes.from_embeddings(spark, grown).where("splat_id < 300"), options).drop("scene").cache()
    whole = codecs.to_arrays(coded, options)
    monkeypatch.setattr(codecs, "BLOCK_ROWS", 7)
    monkeypatch.setattr(codecs, "STRETCH", 8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    try:
        parts = codecs.to_arrays(coded, options)
        back = codecs.from_arrays(spark, parts, options).orderBy("splat_id").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole.keys() == parts.keys() and all(np.array_equal(v, parts[k]) for k, v in whole.items())
    want = coded.orderBy("splat_id").collect()
    assert [r.splat_id for r in back] == list(range(len(want))) and len(want) == 100
    for b, w in zip(back, want, strict=True):
        assert all(b[c] == w[c] for c in back[0].asDict() if c not in ("splat_id", "sh_norm"))
        assert b.sh_norm == np.float16(w.sh_norm)
    none = codecs.to_arrays(coded.where("splat_id < 0"), options)
    assert none["n"] == 0 and codecs.from_arrays(spark, none, options).count() == 0
