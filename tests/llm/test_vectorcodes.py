import hashlib
import math
import random

import duckdb
import pytest

from folioforge.llm import vectorcodes

KIND = "vec_id long, embedding array<double>, label string, id int, v string, code int, error int"


def by_hand(rows, parts=8, entries=16, rounds=6, scale=4096):
    """(vec_id, code, error, label_error, digest) of rows (vec_id, vector, label), in plain Python."""
    kept = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    cut = lambda v, p: (v + [0] * (parts * width - len(v)))[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        members = [[[] for _ in books[p]] for p in range(parts)]
        for _, v, _ in kept:
            for p in range(parts):
                members[p][near(v, p)[1]].append(cut(v, p))
        books = [[[sum(c) // len(m) for c in zip(*m, strict=True)] if m else e for e, m in zip(books[p], members[p], strict=True)] for p in range(parts)]
    found = [(i, label, [near(v, p) for p in range(parts)]) for i, v, label in kept]
    errors = [sum(d for d, _ in f) for _, _, f in found]
    of = {}
    for (_, label, _), e in zip(found, errors, strict=True):
        of[label] = of.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), e, of[label], digest) for (i, label, f), e in zip(found, errors, strict=True)), key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], KIND)


def check(spark, rows, **more):
    got = vectorcodes.vector_codes(table(spark, rows), **more)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == by_hand(rows, **more)


def test_agrees_with_sql(spark):
    c = duckdb.connect()
    c.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    assert sorted(map(tuple, vectorcodes.query(spark, "/root/testdata/sf0.001").collect())) == sorted(c.sql(vectorcodes.SQL).fetchall())


def test_nulls_ties_repeats_and_odd_lengths(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(16)], rng.choice(["a", "b", None])) for i in range(60)]
    rows += [(5, rows[5][1], "a"), (5, rows[5][1], "a"), (None, rows[7][1], None), (70, None, "a"), (71, [1.0, None] * 8, "b"), (72, [float("nan")] * 16, "b"), (73, [float("inf")] * 16, None)]
    check(spark, rows)
    check(spark, [*rows, (80, [0.5, -0.5, 0.25], "c"), (81, [], "c"), (82, [rng.uniform(-1, 1) for _ in range(21)], None)])
    check(spark, [(i, [0.25] * 8, "same") for i in range(30)])  # entries that nothing is nearest to stay


def test_few_rows_and_empty_tables(spark):
    check(spark, [(3, [1.0] * 8, None), (1, [-1.0] * 8, None)])
    assert vectorcodes.vector_codes(table(spark, [])).count() == 0
    assert vectorcodes.vector_codes(table(spark, [(1, None, "a")])).count() == 0
    check(spark, [(1, [], "a")])


def test_components_beyond_long_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 9, 15]) for _ in range(8)], None) for i in range(40)]
    got, want = vectorcodes.vector_codes(table(spark, rows)).collect(), by_hand(rows)
    top = (1 << 63) - 1
    assert sorted(map(tuple, got), key=str) == sorted(((i, code, min(e, top), top, d) for i, code, e, _, d in want), key=str)


def test_long_vectors_are_blocks_of_their_own(spark):
    rng = random.Random(5)
    check(spark, [(i, [rng.uniform(-1, 1) for _ in range(4000)], "x") for i in range(20)], rounds=2)


@pytest.mark.parametrize("parts", [1, 7])
def test_any_partitioning_gives_the_same(spark, parts):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    digests = {r.codebooks_sha256 for r in vectorcodes.vector_codes(df.repartition(parts)).select("codebooks_sha256").distinct().collect()}
    assert digests == {vectorcodes.vector_codes(df).first().codebooks_sha256}
