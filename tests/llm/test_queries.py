"""Every corpus query over the smallest tables, held against plain versions."""

import collections
import re
import zlib
from html import unescape

import pytest

from radiantlake.llm import queries

from . import brute


@pytest.fixture(scope="module")
def texts(spark, small):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}


def rows(spark, small, name):
    return queries.QUERIES[name](spark, small).collect()


def test_op1(spark, small):
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = rows(spark, small, "op1_page_text")
    assert len(got) == len(pages)
    for r in got:
        html = pages[r.page_id].html
        body = html[html.index("<article>") :].split("</article>")[0]
        blocks = [" ".join(unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|article)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_op2(spark, small, texts):
    for r in rows(spark, small, "op2_pii"):
        base = brute.pii(texts[r.doc_id])
        kinds = collections.Counter(x[2] for x in base)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))
        assert r.base_sha256 == brute.digest(brute.joined(base))
        assert set(filter(None, brute.joined(base).split(","))) <= set(r.spans.split(","))


def test_op3(spark, small, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    ids = {d: [*t.encode(x, add_special_tokens=False).ids, 1] for d, x in texts.items()}
    n, total = brute.packed([tuple(r) for r in rows(spark, small, "op3_packing")], ids)
    assert n <= -(-total // 4096) + 1


def test_op4(spark, small, texts):
    fps = {d: brute.fingerprint(x) for d, x in texts.items()}
    own = brute.components(fps)
    got = rows(spark, small, "op4_simhash")
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in got} == {d: (fps[d], own[d]) for d in fps}


def test_op5(spark, small):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = rows(spark, small, "op5_url_filter")
    assert {r.page_id: tuple(r)[1:] for r in got} == {p: brute.url(u, queries.URL_RULES) for p, u in pages.items()}


def test_op6(spark, small, texts):
    items = {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    whole = {(d, i) for d, x in texts.items() for i, y in items.items() if y in x}
    got = {(r.doc_id, r.item_id) for r in rows(spark, small, "op6_decontamination")}
    words = lambda t: re.sub(r"[^\w\s]", "", t.lower()).split()
    grams = lambda t: {tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)}
    assert whole <= got
    for d, i in got:
        assert len(grams(items[i]) & grams(texts[d])) >= 0.4 * len(grams(items[i]))


def test_op7(spark, small, texts):
    for r in rows(spark, small, "op7_quality"):
        assert tuple(r)[1:7] == brute.quality(texts[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_op8(spark, small, texts):
    got = rows(spark, small, "op8_rendezvous")
    slots = collections.defaultdict(list)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
        slots[r.shard].append(r.slot)
    assert len(got) == len(texts) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_op9(spark, small, texts):
    for r in rows(spark, small, "op9_secrets"):
        base = brute.secrets(texts[r.doc_id])
        kinds = collections.Counter(x[2] for x in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds[k] for k in ("assign", "access", "hex"))
        assert r.spans == brute.joined(base) and r.base_sha256 == brute.digest(r.spans)


def test_op10(spark, small, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    for r in rows(spark, small, "op10_token_counts"):
        n = len(sp.encode(texts[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 4096)
