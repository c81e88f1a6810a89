from collections import defaultdict

from pyspark.sql import functions as F

from folioforge.llm import mixing


def test_targets_by_repeated_resharing(spark):
    sizes = {"a": 1000, "b": 10, "c": 300, "d": 0, None: 90, "é": 5000}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    order = sorted(k for k in sizes if k is not None) + [None]
    w = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    total, caps, target = 1.5 * sum(sizes.values()), {k: 2 * n for k, n in sizes.items()}, dict.fromkeys(sizes, 0.0)
    capped: set = set()
    for _ in range(20):
        left = total - sum(caps[k] for k in capped)
        open_ = [k for k in sizes if k not in capped]
        target = {k: caps[k] for k in capped} | {k: left * w[k] / sum(w[o] for o in open_) for k in open_}
        over = {k for k in open_ if target[k] > caps[k]}
        if not over:
            break
        capped |= over
    assert all(abs(got[k] - target[k]) < 1e-6 for k in sizes)


def test_taken_words_are_near_the_targets_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    first, second = mixing.mix(docs).collect(), mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, first)) == sorted(map(str, second))
    taken, target, longest = defaultdict(int), {}, defaultdict(int)
    for r in first:
        assert 0 <= r.taken <= 2 * r.size and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= longest[s] for s in target)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {r.doc_id: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {r.id: r.times for r in first if r.times and r.size}


def test_heavier_documents_are_taken_more_often(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.when(F.col("id") < 2000, "s").otherwise("t").alias("source"), F.when(F.col("id") % 2 == 0, 4.0).otherwise(1.0).alias("w"))
    got = mixing.mix(df, weight=F.col("w"), weights=(1, 10), share=1.25).filter("source = 's' AND times > 0").groupBy(F.col("id") % 2).count().collect()
    n = {r[0]: r[1] for r in got}
    assert n[0] > 1.2 * n[1]


def test_awkward_rows(docs, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


def near(rows):
    """Whether each source's taken words are within a longest document of its target."""
    taken, target, longest = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        longest[r.source] = max(longest[r.source], r.size)
    return all(abs(taken[s] - target[s]) <= longest[s] for s in target)


def test_rows_without_id_or_with_one_id_come_near_the_target(spark):
    columns = "CASE WHEN id < 500 THEN 'a' ELSE 'b' END AS source"
    text = "CASE WHEN id % 3 = 0 THEN 'three words here' ELSE concat('some four words ', id) END AS text"
    for doc_id in ("CAST(NULL AS LONG)", "7L", "id % 2", "CASE WHEN id % 3 > 0 THEN id END"):
        df = spark.range(1000).selectExpr(f"{doc_id} AS doc_id", text, columns, "id AS __number")
        got = mixing.mix(df, weights=(5, 2)).collect()
        assert len(got) == 1000 and near(got)
        again = mixing.mix(df.repartition(9), weights=(5, 2)).collect()
        assert sorted(map(str, got)) == sorted(map(str, again)), "reruns agree"
        mixed = mixing.mixed_documents(df, weights=(5, 2))
        assert mixed.columns == df.columns and mixed.count() == sum(r.times for r in got)
        assert {r.n for r in mixed.groupBy("__number").agg(F.count("*").alias("n")).collect()} <= {1, 2}


def test_weights_of_zero_are_spread_and_come_last(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "'one two three' AS text", "CASE WHEN id < 2000 THEN 's' ELSE 't' END AS source", "CASE id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN NULL WHEN 2 THEN double('NaN') ELSE 1e-3 END AS w")
    got = mixing.mix(df, weight=F.col("w"), weights=(1, 10), share=0.5).collect()
    mine = [r for r in got if r.source == "s"]
    assert near(got) and 0 < sum(r.times for r in mine) < 500 and all(r.id % 4 == 3 for r in mine if r.times)
    keyed = mixing._keyed(mixing._measured(df, "doc_id", "text", "source", F.col("w")), None, mixing.KEY_BUCKETS, "mix")
    assert keyed.groupBy("__bucket").count().agg(F.max("count")).first()[0] < 10


def test_reruns_agree_where_copies_have_weights_of_their_own(spark):
    df = spark.range(2000).selectExpr("id % 40 AS doc_id", "'one two three' AS text", "'s' AS source", "1D + id % 7 AS w")
    runs = [mixing.mix(df.repartition(n), weight=F.col("w"), weights=(1,), share=0.6) for n in (3, 8, 8)]
    taken = [sorted(map(str, r.collect())) for r in runs]
    assert taken[0] == taken[1] == taken[2]
    counts = [sorted((r.w, r.n) for r in mixing.mixed_documents(df.repartition(n), weight=F.col("w"), weights=(1,), share=0.6).groupBy("w").agg(F.count("*").alias("n")).collect()) for n in (3, 8)]
    assert counts[0] == counts[1]
