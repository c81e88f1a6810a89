import random

import pytest

from folioforge.operators import entities, names

ENTITIES = "entity_id long, display string, canonical string, entity_type string, low string"
ALIASES = "alias_id long, entity_id long, alias string, kind string, key long"
PARTS = ["בית", "ספר", "־", "–", "-", "−", " ", "Straße", "É", "ab", "aab", "x", "ΣΑ", "😀", "'", "%", "_"]


def registry(spark, path, own, further, retired=()):
    gone = spark.createDataFrame([(i,) for i in retired], "entity_id long")
    return names.Registry(spark, path).build(spark.createDataFrame(own, ENTITIES), spark.createDataFrame(further, ALIASES), gone)


def scan(own, further, retired, query):
    """The lookup in plain code: (rank, public name, shown alias) by entity."""
    fold = lambda x: "".join("-" if c in entities.DASHES else c for c in x)
    q, out = fold(query.strip()).lower(), {}
    for i, display, canonical, *_ in own:
        if i in retired:
            continue
        rows = [(1, display, None, False), (2, canonical, None, False)] + [(3, a, n, kind == "OCR_VARIANT") for n, e, a, kind, _ in further if e == i]
        found = []
        for source, name, alias_id, hidden in rows:
            low = fold(name).lower() if name is not None else None
            if low is not None and q in low:
                rank = source if low == q else (4 if low.startswith(q) else 6) + (source == 3)
                found.append((rank, source, low, alias_id, fold(name), hidden))
        if found:
            rank = min(f[0] for f in found)
            shown = sorted((f[0], f[2], f[3], f[4]) for f in found if f[1] == 3 and not f[5])
            public = display if display is not None and display.strip() else canonical
            out[i] = (rank, fold(public) if public is not None else None, shown[0][3] if shown and rank in (3, 5, 7) else None)
    return out


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    rng = random.Random(3)
    word = lambda: rng.choice([None, "", " "]) if rng.random() < 0.08 else "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 7)))
    own = [(i, word(), word(), rng.choice(["PLACE", "BODY", None]), "clash") for i in range(120)]
    further = [(k, rng.randrange(130), word(), rng.choice(["OCR_VARIANT", "OTHER", None]), 1) for k in range(200)]
    further += [(1000 + k, 5, "the same name", "OTHER", 1) for k in range(300)]
    own.append((200, "long " * 4000 + "end", None, "BODY", None))
    retired = {3, 4, 77}
    return own, further, retired, registry(spark, f"{tmp_path_factory.mktemp('names')}/r", own + own[:5], further, retired)


@pytest.mark.parametrize("query", ["a", "ab", "aab", "בית־ספר", "בית-ספר", "בית", "x–x", "−", "straße", "STRASSE", "É", "é", "😀", "the same", "SAME name", "g end", "'", "%", "_", "nowhere to be found", "aabaab", " x "])
def test_lookup_equals_a_scan(filled, query):
    own, further, retired, made = filled
    mine = {r.entity_id: (r["rank"], r.public, r.matched_alias) for r in made.lookup(query).collect()}
    assert mine == scan(own, further, retired, query)


def test_pages_are_cut_after_ranking_and_clamped(filled):
    own, further, retired, made = filled
    want = sorted((rank, public.lower() if public is not None else "", i) for i, (rank, public, _) in scan(own, further, retired, "a").items())
    got = []
    for number in range(1, 1 + -(-len(want) // 7)):
        rows, at, total = made.page("a", number, 7)
        assert (at, total) == (number, len(want))
        got += [r.entity_id for r in rows.orderBy("place").collect()]
    assert got == [i for _, _, i in want]
    last, at, _ = made.page("a", 99, 7)
    assert at == -(-len(want) // 7) and [r.entity_id for r in last.orderBy("place").collect()] == got[(at - 1) * 7 :]
    assert made.page("nowhere to be found", 5)[1:] == (1, 0)


def test_blank_query_lists_all_hebrew_first(spark, tmp_path):
    own = [(1, "zebra", "z", "A", ""), (2, "״אבן", "z", "A", ""), (3, " ", "Éclair", "B", ""), (4, "בית", "z", "B", ""), (5, None, None, "B", ""), (6, "éclair", "z", "A", "")]
    made = registry(spark, f"{tmp_path}/r", own, [])
    rows, number, total = made.page("  ", 0, 10)
    assert [r.entity_id for r in rows.orderBy("place").collect()] == [2, 4, 1, 3, 6, 5] and (number, total) == (1, 6)
    assert sorted(r.entity_id for r in made.lookup("", "B").collect()) == [3, 4, 5]


def test_empty_registry(spark, tmp_path):
    made = registry(spark, f"{tmp_path}/r", [], [])
    assert made.lookup("a").count() == 0 and made.lookup("").count() == 0 and made.page("")[1:] == (1, 0)


def test_probes_read_little(filled):
    plan = filled[3].matches("the same")._jdf.queryExecution().toString()
    assert "PushedFilters: [In(gram" in plan and "dynamicpruning" in plan.lower()
