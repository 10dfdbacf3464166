"""The pipeline, stage by stage, against plain versions."""

import re

import pytest

import corpus_pipeline as cp
from radiantlake.llm import queries

from . import brute


def words(t):
    return re.sub(r"[^\w\s]", "", t.lower()).split()


def grams(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = [("documents", docs)]
    for name, stage in cp.STAGES:
        stage(spark, docs, small).write.parquet(str(folder / name))
        docs = spark.read.parquet(str(folder / name))
        out.append((name, docs))
    return dict(out)


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "near_dedup", "decontamination", "secret_scan", "packing"]
    names = list(stages)
    for n in names[1:-1]:
        assert stages[n].columns == stages["documents"].columns


def test_quality_rules(stages):
    before, after = texts(stages["documents"]), texts(stages["quality_rules"])

    def good(t):
        n, chars, symbols, dups, _, failed = brute.quality(t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return not (failed or 10 * symbols > 3 * n or 100 * dups > 35 * len(lines) or 2 * len(re.findall("[A-Z]", t)) > chars)

    assert after == {i: t for i, t in before.items() if good(t)}


def test_near_dedup(stages):
    """One document of each group by exact similarity stays, the one of the smallest doc_id."""
    before, after = texts(stages["quality_rules"]), texts(stages["near_dedup"])
    ids = sorted(before)
    own = brute.similar([before[i] for i in ids])
    assert after == {ids[k]: before[ids[k]] for k in set(own)} and len(after) < len(before)


def test_decontamination(stages, spark, small):
    before, after = texts(stages["near_dedup"]), texts(stages["decontamination"])
    items = [r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for i, t in before.items():
        own = grams(t)
        most = max(len(own & grams(x)) / len(grams(x)) for x in items if grams(x))
        assert not (i in after and most > 0.6)
        assert i in after or most > 0.4


def test_secret_scan(stages):
    before, after = texts(stages["decontamination"]), texts(stages["secret_scan"])
    assert before.keys() == after.keys()
    for i, t in before.items():
        spans = sorted(brute.secrets(t))
        assert (t == after[i]) == (not spans)
        assert not any(t[s:e] in after[i] for s, _, _, e in spans)


def test_packing(stages):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    ids = {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in texts(stages["secret_scan"]).items()}
    n, total = brute.packed([tuple(r) for r in stages["packing"].collect()], ids)
    assert n <= -(-total // 4096) + 1


def test_run(spark, small, stages):
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(cp.run(spark, small).select(key).collect()) == sorted(stages["packing"].select(key).collect())
