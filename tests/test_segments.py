import random

from folioforge.operators import segments

KIND = "item_id long, title string, metadata string, body string, translation string"
WORDS = ["alpha", "beta", "gamma", "Delta", "épsilon", "zeta-eta", "x1"]


def frame(spark, rows):
    return spark.createDataFrame([(i, *fields) for i, fields in rows.items()], KIND)


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "item_id long")


def document(rng):
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    return text(3), text(3), text(12), rng.choice([None, text(6)])


def rebuilt(spark, rows, path):
    other = segments.Index(spark, path)
    other.refresh(frame(spark, rows), ids(spark, rows))
    return other


def same(a, b):
    assert sorted(map(tuple, a.documents().collect())) == sorted(map(tuple, b.documents().collect()))
    assert sorted(map(tuple, a.postings().collect())) == sorted(map(tuple, b.postings().collect()))
    for query in ("alpha", "beta GAMMA", "eta", "", "x1 x1 zeta", "-", "q" * 201):
        assert sorted(map(tuple, a.search(query).collect())) == sorted(map(tuple, b.search(query).collect())), query


def test_refreshes_and_merges_equal_a_rebuilt_index(spark, tmp_path):
    rng = random.Random(7)
    rows = {i: document(rng) for i in range(40)}
    own = segments.Index(spark, f"{tmp_path}/own")
    own.refresh(frame(spark, rows), ids(spark, rows))
    for step in range(6):
        changed = rng.sample(range(50), 8)
        for i in changed:
            rows.pop(i, None)
            if rng.random() < 0.7:
                rows[i] = document(rng)
        own.refresh(frame(spark, rows), ids(spark, [*changed, changed[0], None]))
        if step == 2:
            same(own, rebuilt(spark, rows, f"{tmp_path}/{step}"))
    whole = rebuilt(spark, rows, f"{tmp_path}/whole")
    same(own, whole)
    assert len(own.manifest()) == 7
    assert own.compact(fan=3) == 1 and own.manifest()[0][2] == 1
    same(own, whole)
    assert own.manifest()[0][1] == len(rows)  # tombstones have nothing below them


def test_a_refresh_writes_its_own_items_alone(spark, tmp_path):
    rng = random.Random(8)
    rows = {i: document(rng) for i in range(30)}
    own = segments.Index(spark, f"{tmp_path}/own")
    own.refresh(frame(spark, rows), ids(spark, rows))
    rows[3] = ("new title", "", "word", None)
    name = own.refresh(frame(spark, rows), ids(spark, [3, 4, 99]))
    folder = f"{tmp_path}/own/segments/{name}"
    assert sorted(r.item_id for r in spark.read.parquet(f"{folder}/named").collect()) == [3, 4, 99]
    assert {r.item_id for r in spark.read.parquet(f"{folder}/postings").collect()} <= {3, 4}
    assert own.refresh(frame(spark, rows), ids(spark, [])) is None and len(own.manifest()) == 2


def test_merges_in_the_middle_keep_tombstones(spark, tmp_path):
    own = segments.Index(spark, f"{tmp_path}/own")
    rows = {1: ("alpha", "", "", None), 2: ("alpha", "", "", None), 3: ("alpha", "", "", None)}
    own.refresh(frame(spark, rows), ids(spark, rows))
    base = own.manifest()
    own._commit([(base[0][0], base[0][1], 5)])  # a base of a higher level is not merged
    own.refresh(frame(spark, {}), ids(spark, [1]))
    own.refresh(frame(spark, {}), ids(spark, [2]))
    assert own.compact(fan=2) == 2 and [level for _, _, level in own.manifest()] == [5, 1]
    assert [r.item_id for r in own.search("alpha").collect()] == [3]


def test_lost_refreshes_are_not_seen_and_old_segments_go(spark, tmp_path):
    own = segments.Index(spark, f"{tmp_path}/own")
    assert own.manifest() == [] and own.search("alpha").count() == 0 and own.remove_unused() == 0
    rows = {1: ("alpha", "", "", "")}
    own.refresh(frame(spark, rows), ids(spark, rows))
    other = frame(spark, {2: ("alpha", "", "", "")})
    own._write(ids(spark, [2]), other, segments.built(other))  # no manifest names it
    assert [r.item_id for r in own.search("alpha").collect()] == [1]
    assert own.remove_unused() == 1 and own.remove_unused() == 0
    assert [r.item_id for r in own.search("alpha").collect()] == [1]


def test_tokens_are_counted_within_rows(spark):
    from collections import Counter

    from pyspark.sql import functions as F

    from folioforge.operators import search

    kind = "item_id long, title string, metadata string, body string"
    once = [(1, "b a", "x", "b a b, c"), (2, "", "-", " "), (3, "é É e", "1", "z" * 9)]
    several = [*once, (1, "a", "", "c d"), (None, "n", "", "n"), (None, "n", "", "")]

    def want(rows):
        n, first = Counter(), {}
        for i, *texts in rows:
            for f, text in zip("ABC", texts, strict=True):
                for at, t in enumerate(text.replace("-", " ").replace(",", " ").lower().split()):
                    n[i, t, f] += 1
                    first[i, t, f] = min(at, first.get((i, t, f), at))
        return sorted(((*k, n[k], first[k]) for k in n), key=str)

    for rows in (once, several):
        got = search.postings(spark.createDataFrame(rows, kind))
        assert sorted(map(tuple, got.collect()), key=str) == want(rows)
    plain = search.postings(spark.createDataFrame(once, kind))
    assert "Exchange" not in plain._jdf.queryExecution().executedPlan().toString()
    dealt = search.in_buckets(plain.withColumn("bucket", search.bucket_of(F.col("token"))), 5 * search.BUCKETS * search.TASK_POSTINGS)
    assert dealt.rdd.getNumPartitions() == 5 * search.BUCKETS and dealt.count() == plain.count()
