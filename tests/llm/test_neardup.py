import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioforge.llm import neardup
from folioforge.llm.shingles import Circulant, shingle_set, similar

from .conftest import words


def plain_sets(rows):
    out = {}
    for i, text in rows:
        w = words(text)
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def brute(rows):
    sets = plain_sets(rows)
    at = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            at[x].append(i)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in at[x] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_small_documents(spark, small):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == brute([(d["doc_id"], d["text"]) for d in small])


@pytest.mark.parametrize("block", [512, 7])
def test_planted_copies_chains_and_shared_passages(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(3)
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows, base, passage = [], new(120), new(60)
    for _ in range(60):  # near copies at many distances
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = new(1)[0]
        rows.append(w)
    chain = new(100)
    for _ in range(25):  # each like the one before, not like the first
        chain = [*chain[2:], *new(2)]
        rows.append(list(chain))
    rows += [[*new(70), *passage, *new(70)] for _ in range(60)] + [[*passage, *new(rng.randrange(5, 30))] for _ in range(40)]
    rows += [new(3), new(2), new(4)] + [list(base)] * 20 + [["Short", "One"]] * 3
    rng.shuffle(rows)
    data = [(i, " ".join(w).upper() if i % 7 == 0 else " \n".join(w)) for i, w in enumerate(rows)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert got == brute(data)


def test_awkward_rows(docs, empty):
    got = neardup.near_duplicates(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert len(got) == docs.count()
    assert by[3][0].n_shingles == 0 and by[3][0].component_id == 3 and by[3][0].kept
    assert by[2][0].component_id == 1 and not by[2][0].kept and len(by[7]) == 2 and by[7][0].n_shingles == 1
    assert sorted((r.n_shingles > 0, r.component_id, r.kept) for r in by[None]) == [(False, None, True), (True, 1, False)]
    left = neardup.deduplicated_documents(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, i) for i in (1, 3, 4, 5, 6, 7, 9)] + [(True, 0)]
    assert neardup.near_duplicates(empty).count() == 0 and neardup.deduplicated_documents(empty).count() == 0


def test_rows_without_any_id(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "other words are in this text")], "doc_id long, text string")
    assert neardup.deduplicated_documents(df).count() == 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    maker = Circulant(240)
    for share in (0.3, 0.75, 0.95):
        common = rng.integers(0, 2**64, 600, dtype=np.uint64)
        extra = int(600 * (1 / share - 1) / 2)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 2**64, extra, dtype=np.uint64)])) for _ in range(2))
        agree = (maker.signature(a) == maker.signature(b)).mean()
        assert abs(agree - share) < 0.12
        assert similar(a, b) == (100 * 600 >= 75 * (len(a) + len(b) - 600))


def test_words_are_parted_and_lowered_as_bytes():
    assert len(shingle_set("A b c d e f")) == 1 and (shingle_set("a b\tc\x0bd\x0ce\rf") == shingle_set("A B C D E F")).all()
    assert (shingle_set("É b") != shingle_set("é b")).all()


def test_no_text_of_a_repeated_id_is_lost(spark):
    rows = [(1, "first text of the first id here"), (1, "quite another text of the same id"), (1, "First text of the  first id here"), (2, "text of the second id stands alone"), (1, None), (1, " ")]
    rows += [(3, "quite another text of the same id"), (3, "and one of its own besides this"), (4, "quite another text of the same id")]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, k int")
    for parts in (1, 5):
        left = sorted((r.doc_id, " ".join((r.text or "").lower().split())) for r in neardup.deduplicated_documents(df.repartition(parts)).collect())
        assert left == [(1, ""), (1, "first text of the first id here"), (1, "quite another text of the same id"), (2, "text of the second id stands alone"), (3, "and one of its own besides this")]
