import random

import duckdb
import numpy as np
import pytest

from folioforge.llm import ngramjoin
from tests.llm.conftest import words


def grams(text, size=3):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def alike(a, b, percent=90):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def by_hand(rows, percent=90):
    """(id, n, least id of the component) of rows (id, text), by comparing all pairs."""
    sets = [grams(t) for _, t in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(sets[i], sets[j], percent):
                group[max(find(i), find(j))] = min(find(i), find(j))
    ids = {}
    for k, (i, _) in enumerate(rows):
        ids.setdefault(find(k), []).append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in ids.items()}
    return sorted(((i, len(sets[k]), least[find(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)), key=str)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "x", 2, "y") for r in rows], "doc_id long, text string, node int, grams string, n int, key string")
    return sorted(map(tuple, ngramjoin.jaccard_groups(df, **more).collect()), key=str)


def edits(rng, base, most):
    w = list(base)
    for _ in range(rng.randrange(most)):
        k = rng.randrange(len(w))
        match rng.randrange(3):
            case 0:
                w[k] = f"new{rng.randrange(10**6)}"
            case 1:
                del w[k]
            case _:
                w.insert(k, "also")
    return w


def family(rng, n, length, most):
    base = [f"w{rng.randrange(300)}" for _ in range(length)]
    return [" ".join(edits(rng, base, most)) for _ in range(n)]


@pytest.mark.parametrize("block", [512, 4])
def test_agrees_with_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ngramjoin, "BLOCK_NODES", block)
    rng = random.Random(block)
    texts = [t for length, most in [(40, 5), (120, 9), (400, 30), (25, 3), (12, 2), (4, 2), (60, 12)] for t in family(rng, 14, length, most)]
    texts += [" ".join(f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 40))) for _ in range(40)] + texts[:5] + ["one", "ONE", "one two", "a b c", "A b C", "a b c d"]
    rng.shuffle(texts)
    assert got(spark, list(enumerate(texts))) == by_hand(list(enumerate(texts)))


def test_sizes_at_the_threshold(spark):
    """19 of 20, 18 of 20 and 9 of 10 n-grams, and one less."""
    rows = []
    for k, (n, other) in enumerate([(20, 19), (20, 18), (20, 17), (10, 9), (10, 8), (100, 90), (100, 89), (1000, 900), (1000, 899)]):
        w = [f"f{k}x{i}" for i in range(n + 2)]
        rows += [(10 * k, " ".join(w)), (10 * k + 1, " ".join(w[: other + 2]))]
    result = got(spark, rows)
    assert result == by_hand(rows)
    assert [c for i, _, c in sorted(result) if i % 10] == [0, 10, 21, 30, 41, 50, 61, 70, 81]


def test_a_common_passage_does_not_link(spark):
    rng = random.Random(9)
    passage = " ".join(f"common{i}" for i in range(30))
    rows = [(i, f"{passage} " + " ".join(f"r{rng.randrange(10**6)}" for _ in range(8))) for i in range(120)]
    rows += [(200 + i, f"{passage} end{i % 3}") for i in range(9)]
    assert got(spark, rows) == by_hand(rows)


def test_the_trie_finds_what_comparing_finds():
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))

    def one():
        kept = base[rng.random(len(base)) > rng.choice([0.0, 0.02, 0.05, 0.3])][: rng.integers(1, 300)]
        return np.unique(np.concatenate([kept, rng.integers(0, 1 << 62, rng.integers(0, 12)).astype(np.uint64)]))

    left, right = [one() for _ in range(60)], [one() for _ in range(40)]
    trie, probes = ngramjoin.Trie(left), ngramjoin.Probes(right)
    found = sorted((trie.order[i], j, k) for i, j, k in ngramjoin.join(trie, probes, ngramjoin.Jaccard(trie, probes)))
    size = lambda a, b: len(np.intersect1d(a, b))
    want = sorted((i, j, size(a, b)) for i, a in enumerate(left) for j, b in enumerate(right) if ngramjoin.similar_sizes(size(a, b), len(a), len(b)))
    assert found == want and len(want) > 20


def test_awkward_documents(spark, docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, ngramjoin.jaccard_groups(docs).collect()), key=str) == by_hand(rows)
    assert ngramjoin.jaccard_groups(empty).count() == 0
    assert ngramjoin.jaccard_groups(docs.filter("text IS NULL")).count() == 2


def test_agrees_with_sql(spark):
    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    assert sorted(map(tuple, ngramjoin.query(spark, "/root/testdata/sf0.001").collect())) == sorted(c.sql(ngramjoin.SQL).fetchall())
