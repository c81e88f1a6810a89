import math
from collections import Counter

import numpy as np

from folioforge.llm import lmscore

from .conftest import crc, words


def test_base_by_plain_code(spark, small):
    got = {r.doc_id: r for r in lmscore.query(spark, "/root/testdata/sf0.001").collect()}
    tokens = {d["doc_id"]: [*words(d["text"]), None] for d in small}
    c = Counter(t for i, ts in tokens.items() if crc(i) % 10 for t in ts)
    n, v = sum(c.values()), len(c)
    for i, ts in tokens.items():
        r = got[i]
        base = sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (crc(i) % 10 == 0, len(ts), sum(c[t] > 0 for t in ts), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0


def test_words_beyond_the_head_are_exact(spark, small):
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in small], "doc_id long, text string")
    rows = {}
    for head in (1 << 20, 50):
        model, tail = lmscore.train(df, head=head)
        assert len(model.head_keys) <= head
        rows[head] = {r.id: r for r in lmscore.score(df, model, tail).collect()}
    for i, r in rows[50].items():
        assert r.n_known == rows[1 << 20][i].n_known == r.n_tokens
        assert math.isclose(r.base_score, rows[1 << 20][i].base_score, rel_tol=1e-9)


def test_filter_holds_levels_and_stays_within_its_bound():
    rng = np.random.default_rng(0)
    keys, counts = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64)), None
    counts = rng.zipf(1.5, len(keys)).clip(1, 10**6)
    levels = lmscore.level_of(counts)
    histogram = [np.bincount(levels, minlength=lmscore.MAX_LEVEL + 1), np.zeros(lmscore.MAX_LEVEL + 1, int)]
    for bound in (1 << 20, 1 << 15):
        first, bits = lmscore.filter_shape(histogram, 1, bound)
        assert sum(bits) <= bound + 128
        data = np.frombuffer(lmscore.segment(keys, levels, first[0], bits[0]), np.uint8)
        f = lmscore.Filter(1, first, bits, (data, np.zeros(bits[1] // 8, np.uint8)))
        found = f.levels(0, keys)
        assert (found >= np.where(levels >= first[0], levels, 0)).all(), "a level is never read too low"
        assert (found == np.where(levels >= first[0], levels, 0)).mean() > 0.95
        strange = f.levels(0, rng.integers(0, 2**64, 5000, dtype=np.uint64))
        assert (strange > 0).mean() < 0.05


def test_probabilities_fit_text_better_than_unigrams(spark):
    text = "the cat sat on the mat and the dog sat on the rug " * 40
    df = spark.createDataFrame([(i, text) for i in range(20)], "doc_id long, text string")
    model, tail = lmscore.train(df, prior=5.0)
    r = lmscore.score(df, model, tail).first()
    assert r.score > r.base_score


def test_awkward_rows(docs, empty):
    model, tail = lmscore.train(docs)
    got = lmscore.score(docs, model, tail).collect()
    assert len(got) == docs.count() and {r.n_tokens for r in got if r.id in (3, 4, 5)} == {1}
    none, none_tail = lmscore.train(empty)
    assert none.train_tokens == 0 and lmscore.score(empty, none, none_tail).count() == 0
    assert all(math.isfinite(r.score) and r.n_known == 0 for r in lmscore.score(docs, none, none_tail).collect())


def test_words_and_pairs_seen_once_keep_their_level_in_every_shard(spark, small):
    df = spark.createDataFrame([(d["doc_id"], d["text"]) for d in small], "doc_id long, text string")
    got = []
    for shard_bytes in (1 << 30, 1 << 12):
        model, tail = lmscore.train(df, shard_bytes=shard_bytes)
        got.append({r.id: r.score for r in lmscore.score(df, model, tail).collect()})
    tokens = {d["doc_id"]: [*words(d["text"]), None] for d in small}
    c, p = Counter(t for ts in tokens.values() for t in ts), Counter(x for ts in tokens.values() for x in zip([0, *ts], ts))
    assert sum(n == 1 for n in p.values()) > 1000
    seen = lambda n: float(lmscore.count_of(lmscore.level_of(np.array([n])))[0])
    off = [0, 0]
    for i, ts in tokens.items():
        want = 0.0
        for a, b in zip([0, *ts], ts):
            before = len(small) if a == 0 else seen(c[a])
            want += math.log10((min(seen(p[a, b]), seen(c[b]), before) + 1000 * (seen(c[b]) + 0.1) / model.norm) / (before + 1000))
        for k in range(2):
            off[k] += abs(got[k][i] - want) > 0.002 * abs(want)
    assert max(off) < 0.05 * len(small), "but for false positives of the filter, levels are those of exact counts"
