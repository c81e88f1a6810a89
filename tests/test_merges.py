import random

from folioforge.plans import merges

KIND = "retired long, target long"


def plain(pairs):
    """(keepers, cycles) by walking."""
    to = {}
    for a, b in pairs:
        if a is not None and b is not None:
            to[a] = min(b, to.get(a, b))
    ends, cycles = {}, set()
    for start in to:
        trail, node = [], start
        while node in to and node not in trail:
            trail.append(node)
            node = to[node]
        ends[start] = (None, None) if node in to else (node, len(trail))
        if node in to:
            ring = trail[trail.index(node) :]
            k = ring.index(min(ring))
            cycles.add(tuple(ring[k:] + ring[:k]))
    return ends, cycles


def check(spark, pairs):
    df = spark.createDataFrame(pairs, KIND)
    ends, cycles = plain(pairs)
    assert {r.retired: (r.keeper, r.steps) for r in merges.keepers(df).collect()} == ends
    got = {}
    for r in sorted(merges.cycle_members(df).collect()):
        got.setdefault(r.cycle, []).append((r.place, r.member))
    assert {tuple(m for _, m in x) for x in got.values()} == cycles and all([p for p, _ in x] == list(range(len(x))) for x in got.values())


def test_chains_end_at_the_last_and_rings_are_told_in_order(spark):
    check(spark, [(1, 2), (2, 3), (9, 2), (5, 6), (6, 7), (7, 5), (8, 6), (4, 4), (10, 4), (11, None), (None, 3), (1, 9)])
    order = random.Random(1).sample(range(50), 50)
    check(spark, [(order[i], order[(i + 1) % 50]) for i in range(50)] + [(100 + i, 101 + i) for i in range(40)])


def test_random_merges(spark):
    rng = random.Random(2)
    check(spark, [(i, rng.randrange(60)) for i in rng.sample(range(60), 45)])


def test_nothing_to_merge(spark):
    df = spark.createDataFrame([], KIND)
    assert merges.keepers(df).count() == merges.cycle_members(df).count() == merges.cycle_errors(df).count() == 0


def test_errors_and_moves(spark):
    df = spark.createDataFrame([(3, 1), (1, 2), (2, 3), (7, 8), (8, 9), (5, 5), (6, 3)], KIND)
    assert [tuple(r) for r in merges.cycle_errors(df).collect()] == [(1, "MERGE_CYCLE: 1 -> 2 -> 3 -> 1")]
    links = spark.createDataFrame([(7, "a"), (8, "a"), (9, "b"), (4, "c"), (6, "d"), (1, "e")], "person long, label string")
    kept, lost = merges.moved(links, df, "person")
    assert sorted(map(tuple, kept.collect())) == [(4, "c"), (9, "a"), (9, "b")] and sorted(map(tuple, lost.collect())) == [(1, "e"), (6, "d")]
