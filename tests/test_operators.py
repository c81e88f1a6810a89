import random

import pytest
from pyspark.sql import functions as F

from folioforge.operators import access, directory, entities, graph, ordered, selection
from folioforge.plans import diffs
from folioforge.streaming import leases


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_unknown_visibility_fails_closed(spark):
    df = spark.createDataFrame([(1, "PUBLIC"), (2, "PRIVATE"), (3, "RESTRICTED"), (4, "ODD"), (5, None)], "item_id long, visibility string")
    assert [[r[0] for r in access.visible(df, role).collect()] for role in ("public", "family", "admin", "stranger")] == [[1], [1, 2], [1, 2, 3], [1]]


def test_closure_ends_on_cycles_and_keeps_least_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "y")], "parent string, child string")
    got = {(r.ancestor, r.descendant): r.depth for r in graph.closure(edges).collect()}
    assert got["a", "c"] == 1 and got["a", "a"] == 2 and got["c", "b"] == 2 and got["x", "y"] == 1 and len(got) == 10
    assert {r.node for r in graph.cycles(graph.closure(edges)).collect()} == {"a", "b", "c"}
    assert graph.closure(edges.filter("false")).count() == 0


def test_a_task_of_line_clusters_takes_a_bounded_share_of_words(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SHARE_WORDS", 10)
    rng = random.Random(7)
    words = [(rng.randrange(12), k, float(a := rng.randrange(60)), float(a + rng.randrange(5))) for k in range(95)] + [(None, 99, 1.0, 2.0)]
    want = []
    for page in {w[0] for w in words}:
        own = []
        for _, _, low, high in sorted((w for w in words if w[0] == page), key=lambda w: (w[2], w[3], w[1])):
            if own and low <= max(x[1] for x in own):
                own[-1] = (own[-1][0], max(own[-1][1], high), own[-1][2] + 1)
            else:
                own.append((low, high, 1))
        want += [(page, k, *x) for k, x in enumerate(own, 1)]
    got = ordered.line_clusters(spark.createDataFrame(words, "page long, word long, ymin double, ymax double"))
    assert rows(got) == sorted(want, key=str)
    assert got.rdd.getNumPartitions() == 10 and ordered.line_clusters(got.selectExpr("page", "cluster AS word", "ymin", "ymax").filter("false")).count() == 0


def test_a_task_of_an_entity_run_takes_a_bounded_share_of_hits(spark, monkeypatch):
    monkeypatch.setattr(entities, "SHARE_CHARS", 20)
    texts = [(k % 9, "of the old town of the old") for k in range(12)] + [(20, ""), (21, None)]  # ids repeat
    items = spark.createDataFrame(texts, "item_id long, text string").withColumn("sha", F.sha2("text", 256))
    names = spark.createDataFrame([("of the",), ("the",), ("old",), ("old town",)], "surface string")
    stored = spark.createDataFrame([(1, "of the", 0), (1, "of the", 0), (50, "old", 1)], "item_id long, surface string, start int")
    appended, counts, report = entities.examine(items, names, stored)
    per = [("of the", 0), ("old town", 2), ("of the", 4), ("old", 6)]
    want = [(k, *x) for k in range(9) for x in per if (k, *x) != (1, "of the", 0)]
    assert rows(appended.select("item_id", "surface", "start")) == sorted(want, key=str)
    assert rows(counts) == [(35, 1)] and rows(report) == [(14, 1, 20)]
    assert appended.rdd.getNumPartitions() == 1 + 12 * 26 // 20  # more texts, more partitions
    assert entities.shares(items.filter("text IS NULL")) == 1


def test_surviving_hits_by_pairwise_comparison(spark):
    rng = random.Random(5)
    hits = [(i % 4, f"s{k}", a := rng.randrange(30), a + rng.randrange(1, 8)) for i in range(150) for k in range(1)]
    df = spark.createDataFrame(hits, "item_id long, surface string, start int, end int")
    want = [h for h in hits if not any(o[0] == h[0] and o[2] <= h[2] and o[3] >= h[3] and o[3] - o[2] > h[3] - h[2] for o in hits)]
    assert rows(entities.surviving(df)) == sorted(want, key=str)


def test_detection_stands_between_word_bounds(spark):
    texts = spark.createDataFrame([(1, "The New York times; NEW york, newyork york"), (2, ""), (3, None)], "item_id long, text string")
    names = spark.createDataFrame([("new york",), ("york",), ("",)], "surface string")
    assert rows(entities.detect(texts, names)) == [(1, "new york", 1, 3), (1, "new york", 4, 6), (1, "york", 2, 3), (1, "york", 5, 6), (1, "york", 7, 8)]
    with pytest.raises(ValueError):
        entities.detect(texts, spark.createDataFrame([("a b c d e f g h i",)], "surface string"))
    assert entities.detect(texts, names.filter("false")).count() == 0


def test_places_are_a_total_order(spark):
    df = spark.createDataFrame([(f"n{i % 7}", i) for i in random.Random(1).sample(range(500), 500)], "name string, id long")
    got = directory.with_places(df, ["name", "id"]).collect()
    assert [(r.name, r.id) for r in sorted(got, key=lambda r: r.place)] == sorted((f"n{i % 7}", i) for i in range(500))
    assert sorted(r.place for r in got) == list(range(1, 501))


def test_latest_displayable_prefers_success_and_skips_blanks(spark):
    data = [(1, "T", 1, "SUCCEEDED", "e", "old", 1), (1, "T", 2, "NEEDS_REVIEW", "e", "new", 9), (1, "T", 3, "SUCCEEDED", "e", " \t", 8), (1, "T", 4, "FAILED", "e", "x", 10), (2, "T", 5, "NEEDS_REVIEW", "e", "only", 1), (3, "T", 6, "SUCCEEDED", "e", None, 1)]
    df = spark.createDataFrame(data, "doc_id long, result_type string, result_id long, status string, engine string, text string, created_at long")
    assert {r.doc_id: r.result_id for r in selection.latest_displayable(df).collect()} == {1: 1, 2: 5}


def test_slugs_are_unique(spark):
    names = spark.createDataFrame([(i, n) for i, n in enumerate(["A b", "a-b", "A  B", "c", "x" * 300, "x" * 299])], "id long, name string")
    taken = spark.createDataFrame([("c",)], "slug string")
    got = {r.id: r.slug for r in diffs.unique_slugs(names, taken).collect()}
    assert [got[i] for i in range(4)] == ["a-b", "a-b-2", "a-b-3", "c-2"] and len(got[5]) == 255 and got[5].endswith("-2") and len(set(got.values())) == 6


def test_merge_cycles_are_reported_once(spark):
    merges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, 5), (7, 8)], "retired long, target long")
    assert rows(diffs.merge_cycles(merges)) == [(1,), (5,)]


def test_merge_cycles_of_any_length(spark):
    ring = [(i, (i + 1) % 50) for i in range(50)] + [(100 + i, 101 + i) for i in range(70)] + [(170, 3)] + [(500, 500), (600, None), (None, 5)]
    assert rows(diffs.merge_cycles(spark.createDataFrame(ring, "retired long, target long"))) == [(0,), (500,)]
    assert diffs.merge_cycles(spark.createDataFrame([], "retired long, target long")).count() == 0


def test_slugs_are_those_of_names_that_come_one_by_one(spark):
    rng = random.Random(7)
    few = ["A B", "a  b", "A B 2", "a-b-2-2", "A b 3", "c", "c 2", "c 2 2", "x" * 300, "x" * 253 + " 2", ""]
    for case in ([*few[:2], few[2]], [rng.choice(few) for _ in range(60)], [rng.choice(few) for _ in range(60)]):
        taken = {"c-2", "a-b-4", "x" * 255}
        want, used = {}, set(taken)
        for i, name in enumerate(case):
            base = "-".join("".join(ch if ch.isalnum() else " " for ch in name.lower()).split())[:255] or "item"
            n = 1
            while (s := base if n == 1 else f"{base[: 255 - len(f'-{n}')]}-{n}") in used:
                n += 1
            want[i] = s
            used.add(s)
        df = spark.createDataFrame(list(enumerate(case)), "id long, name string")
        assert {r.id: r.slug for r in diffs.unique_slugs(df, spark.createDataFrame([(t,) for t in taken], "slug string")).collect()} == want


def test_places_hold_under_any_partitioning(spark):
    df = spark.range(1000).selectExpr("id % 3 AS k", "hash(id) AS v", "id")
    for conf in ({}, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "13"}, {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}):
        for c, v in conf.items():
            spark.conf.set(c, v)
        try:
            got = directory.with_places(df.repartition(5), ["v", "id"], within=("k",)).collect()
        finally:
            for c in conf:
                spark.conf.set("spark.sql.shuffle.partitions", "4") if "shuffle" in c else spark.conf.unset(c)
        for k in range(3):
            own = sorted((r for r in got if r.k == k), key=lambda r: (r.v, r.id))
            assert [r.place for r in own] == list(range(1, len(own) + 1))


def test_covers_by_pairwise_comparison(spark):
    rng = random.Random(6)
    hits = list({(i % 3, f"s{rng.randrange(9)}", a := rng.randrange(25), a + rng.randrange(1, 9)) for i in range(120)})
    want = []
    for h in hits:
        covers = [(o[2] - o[3], o[2], o[1]) for o in hits if o[0] == h[0] and o[2] <= h[2] and o[3] >= h[3] and o[3] - o[2] > h[3] - h[2]]
        want += [(*h, min(covers)[2])] if covers else []
    assert rows(entities.cover_of(spark.createDataFrame(hits, "item_id long, surface string, start int, end int"))) == sorted(want, key=str)


def test_a_cut_closure_says_so_and_its_edges_are_refused(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "parent long, child long")
    closed, rest = graph.closure_and_rest(chain)
    assert closed.agg(F.max("depth")).first()[0] == 32 and {r.ancestor for r in graph.truncated(rest).collect()} == set(range(8))
    new = spark.createDataFrame([(40, 0), (40, 10), (50, 20)], "parent long, child long")
    none = spark.createDataFrame([], "low long, high long")
    assert {(r.parent, r.child): r.error for r in graph.edge_errors(new, closed, none, rest).collect()} == {(40, 0): "truncated", (40, 10): "cycle", (50, 20): None}
    assert graph.closure_and_rest(chain.filter("parent < 30"))[1].isEmpty()


def test_earlier_snapshots_by_plain_code(spark):
    from folioforge.plans import reviews

    rng = random.Random(8)
    data = [(i, i % 4, rng.randrange(12)) for i in range(80)]
    want = []
    for i, d, t in data:
        older = sorted((-u, j) for j, e, u in data if e == d and u < t)
        want += [(i, j, k) for k, (_, j) in enumerate(older[:9], 1)]
    assert rows(reviews.earlier(spark.createDataFrame(data, "snapshot_id long, document_id long, created long"), most=9)) == sorted(want, key=str)
    assert reviews.earlier(spark.createDataFrame(data, "snapshot_id long, document_id long, created long")).count() == sum(e == d and u < t for _, d, t in data for _, e, u in data)


def test_registry_search_folds_names_and_query_alike(spark):
    entities_ = spark.createDataFrame([(1, "בית־ספר", "x"), (2, "a-b", "y"), (3, "c", "A−B c"), (4, "z", "z")], "entity_id long, display string, canonical string")
    aliases = spark.createDataFrame([(9, 4, "pre a﹣b", "PLAIN"), (8, 4, "a–b two", "PLAIN"), (7, 4, "a-b", "OCR_VARIANT"), (6, 4, "A-B one", None)], "alias_id long, entity_id long, alias string, kind string")
    find = lambda q: rows(entities.registry_rank(entities_, aliases.select("entity_id", "alias"), q))
    assert find("בית־ספר") == [(1, 1)] and find("בית-ספר") == []
    assert find(" a−b ") == find("A-B") == [(2, 1), (3, 4), (4, 3)]
    assert rows(entities.matched_aliases(aliases, "a—b")) == [(4, "A-B one")]


def test_apply_states(spark):
    make = lambda data: spark.createDataFrame(data, "name string, found long, approved long")
    assert diffs.apply_state(make([("a", 0, 3)])).first()[0] == "ALREADY_APPLIED"
    assert diffs.apply_state(make([("a", 3, 3), ("b", 0, 0)])).first()[0] == "READY_TO_APPLY"
    assert diffs.apply_state(make([("a", 3, 3), ("b", 1, 0)])).first()[0] == "DRIFT"


DELIVERIES = [
    (1, 1, 0.0, "deliver", -1), (1, 2, 60.0, "deliver", -1), (1, 3, 3000.0, "deliver", -1), (1, 4, 3001.0, "COMPLETED", 1), (1, 5, 3002.0, "deliver", -1),
    (2, 6, 0.0, "deliver", -1), (2, 7, 10.0, "COMPLETED", 99), (2, 8, 11.0, "NOOP", 6), (3, 9, 0.0, "recover", -1), (3, 10, 1.0, "deliver", -1), (3, 11, 5000.0, "deliver", -1), (3, 12, 5001.0, "recover", -1), (3, 13, 5002.0, "deliver", -1),
]
OUTCOMES = {1: "EXECUTE", 2: "DEFER", 3: "ACK", 4: "DONE", 5: "ACK", 6: "EXECUTE", 7: "REFUSED", 8: "DONE", 9: "REFUSED", 10: "EXECUTE", 11: "ACK", 12: "REQUEUED", 13: "EXECUTE"}
KIND = "request_id long, event_id long, now double, action string, token long"


def test_lease_replay(spark):
    got = leases.replay(spark.createDataFrame(DELIVERIES, KIND)).collect()
    assert {r.event_id: r.outcome for r in got} == OUTCOMES
    assert {r.event_id: r.status for r in got}[8] == "FAILED"


def test_lease_stream_agrees_with_the_replay(spark, tmp_path):
    df = spark.createDataFrame(DELIVERIES, KIND)
    for k, part in enumerate([df.filter("event_id % 13 IN (1, 2, 6, 9, 10)"), df.filter("event_id % 13 NOT IN (1, 2, 6, 9, 10)")]):
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p{k}")
    source = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = leases.stream(source).writeStream.format("memory").queryName("lease_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").start()
    run.processAllAvailable()
    run.stop()
    assert {r.event_id: r.outcome for r in spark.table("lease_out").collect()} == OUTCOMES


def test_pages_are_clamped_to_the_last(spark):
    from folioforge.operators import search

    df = spark.range(50)

    def page(rows, number, size=24):
        shown, place, total = search.clamped_page(rows, [F.col("id")], number, size)
        return [r.id for r in shown.collect()], place, total

    assert page(df, 9) == ([48, 49], 3, 50) and page(df, -4) == (list(range(24)), 1, 50) and page(df, 2, 7) == ([48, 49], 2, 50)
    assert page(df.filter("false"), 3) == ([], 1, 0)


def test_token_spans_by_a_plain_scan(spark):
    from folioforge.operators import matches

    texts = ["Ab1, cd-é  שלום!", "", " .,", "x", "a\nb\tc ", "日本語 テスト"]
    want = []
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = at
            while end < len(text) and text[end].isalnum():
                end += 1
            want += [(i, at, end, text[at:end])] if end > at else []
            at = max(end, at + 1)
    df = spark.createDataFrame([*enumerate(texts), (9, None)], "item_id long, text string")
    assert sorted(map(tuple, matches.token_spans(df).collect())) == sorted(want)


def test_bands_of_many_pages_by_plan(spark):
    from folioforge.operators import ordered

    rng = random.Random(5)
    pages = {p: [(10.0 * k + rng.randrange(3), 10.0 * k + 5 + rng.randrange(3)) for k in range(rng.randrange(1, 12))] for p in range(30)}
    pages[99] = [(0.0, 1000.0)]  # no plan fits
    df = spark.createDataFrame([(p, k, *x) for p, own in pages.items() for k, x in enumerate(own)], "page long, cluster long, ymin double, ymax double").orderBy(F.rand(1))
    want = []
    for p, own in pages.items():
        cuts = ordered.plan_bands(own, 100.0)
        edges = [] if cuts is None else [0, *cuts, len(own)]
        want += [(p, k, a, b - 1, float((own[a][0] + own[a - 1][1]) // 2) if a else own[0][0]) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    got = ordered.bands(df, 100.0)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().executedPlan().toString()


def test_representatives_by_hand_in_few_sorts(spark):
    from folioforge.plans import reviews

    rng = random.Random(6)
    members = [(g, i, o, rng.random() < 0.1) for g in range(40) for i in rng.sample(range(30), rng.randrange(1, 9)) for o in range(1, rng.randrange(2, 4))]
    want = []
    for g in range(40):
        own, role = sorted(m for m in members if m[0] == g), {}
        for name, m in [("first", own[0]), ("last", own[-1]), *[("unusual", m) for m in own if m[3]][:1], *[("new_item", m) for m in own if m[2] == 1]]:
            role.setdefault(m[:3], name)
        want += [(*k, r) for k, r in list(role.items())[:4]]
    got = reviews.representatives(spark.createDataFrame(members, "group long, item_id long, ordinal int, unusual boolean"))
    assert rows(got) == sorted(want, key=str)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Window [") == 2, "five windows over all members before"


def test_photos_with_all_hold_no_sets(spark):
    links = [(1, 5, 2, "A"), (1, 5, 2, "N"), (1, 5, 2, "A"), (1, 4, 9, "A"), (1, 4, 9, "N"), (2, 7, 1, "A"), (2, 7, 1, None), (3, 1, 1, "N"), (3, 1, 1, "A"), (3, 1, 1, "R")]
    got = directory.photos_with_all(spark.createDataFrame(links, "item_id long, photo_id long, position long, person_id string"), ["A", "N", "A"])
    assert rows(got) == [(1, 5), (3, 1)]
    assert "distinct" not in got._jdf.queryExecution().executedPlan().toString().lower()
