import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioforge.llm import tokenstore

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(FILE)


def test_digests_by_plain_code(spark, small, plain):
    got = {r.doc_id: r for r in tokenstore.query(spark, "/root/testdata/sf0.001").collect()}
    start = 0
    for d in sorted(small, key=lambda d: d["doc_id"]):
        ids = [*plain.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        r = got[d["doc_id"]]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_pieces_give_the_library_s_ids(plain, small):
    own = tokenstore.Encoder(FILE)
    odd = ["a\x0bb c", "x²y 12½", "日本語 test 😀", "<|endoftext|> hi", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "<|endof text|>", "a b", "  two  spaces\n\n x\t\ty ", "don't I'll 'sx 're", "_a_b 1_000", "", "é'è ǆ€", "\x1c x", "ab́c"]
    texts = odd + [d["text"] or "" for d in small]
    for _ in range(2):
        got = [np.frombuffer(raw, own.dtype).tolist() for raw in own.encode(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 5000):
        keys = rng.permutation(rng.integers(0, 2**64, n, dtype=np.uint64))
        own = tokenstore.PerfectHash.build(keys)
        assert sorted(own.find(keys).tolist()) == list(range(n))
    with pytest.raises(ValueError):
        tokenstore.PerfectHash.build(np.array([7, 7], np.uint64))


def test_store_with_awkward_rows(spark, docs, empty, plain, tmp_path):
    folder = tokenstore.write_store(docs, f"file://{tmp_path}/store", tokenizer=FILE, index_bucket=3)
    store = tokenstore.TokenStore(folder)
    rows = docs.select("doc_id", "text").collect()
    want = sorted(([*plain.encode(r.text or "", add_special_tokens=False).ids, 2] for r in rows), key=str)
    own = [ids.tolist() for key in {r.doc_id for r in rows} - {None} for ids in store.get(key)]
    none = [ids.tolist() for s in range(store.n_shards) for _, _, ids in store.null_records(s)]
    assert sorted(own + none, key=str) == want and len(none) == 2
    assert len(store.get(7)) == 2 and store.get(12345) == [] and store.get(-1) == []
    shown = tokenstore.read_digests(spark, folder, docs.select("doc_id")).collect()
    assert len(shown) == len(rows)
    at = sorted((r.start, r.n_tokens) for r in shown)
    assert at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:]))
    assert [r.doc_id for r in sorted(shown, key=lambda r: r.start)] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
    none = tokenstore.write_store(empty, f"file://{tmp_path}/none", tokenizer=FILE)
    assert tokenstore.TokenStore(none).get(1) == [] and tokenstore.read_digests(spark, none, empty.select("doc_id")).count() == 0


def test_a_bucket_s_index_is_read_once_and_a_key_of_many_records_parts_over_shards(spark, plain, tmp_path):
    rows = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 3 = 1 THEN NULL ELSE id END AS doc_id", "concat('text ', id % 50) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        folder = tokenstore.write_store(rows.repartition(6), f"file://{tmp_path}/store", tokenizer=FILE, index_bucket=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    store = tokenstore.TokenStore(folder)
    keys = np.array([r.doc_id for r in rows.filter("doc_id IS NOT NULL").distinct().collect()], np.int64)
    found = list(store.spans(np.unique(keys)))
    assert store.loads <= store.buckets and store.buckets == 30
    assert len({s for k, s, *_ in found if k == 7}) > 1 and len(store.get(7)) == 1000
    shown = tokenstore.read_digests(spark, folder, rows.select("doc_id")).collect()
    at = sorted((r.start, r.n_tokens) for r in shown)
    assert len(at) == 3000 and at[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(at, at[1:]))
    order = [r.doc_id for r in sorted(shown, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    ids = [*plain.encode("text 3", add_special_tokens=False).ids, 2]
    assert sum(r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) for r in shown) == 60
    assert tokenstore.read_digests(spark, folder, rows.filter("doc_id = 7").select("doc_id")).count() == 1000
