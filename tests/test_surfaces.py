import random
import unicodedata

import pytest

from folioforge.operators import surfaces

ODD = ["a", "\u00e9", "e\u0301", "e", "\u0301", "\u00df", "SS", "s", " ", " ", "\n", "\u200f", "\u200e", "\u05e9", "\u05c1", "\u05bc", "\u0130", "\ufb01", "\u1100", "\u1161", "\u11a8", "\uac00", ".", "-", "\u05be", "A", "\u01c6", "\u0327", "\u0323", "\u0915", "\u093c", "x", "1"]


def token(c):
    return unicodedata.category(c)[0] in "LNM"


def by_hand(text, names):
    """The accepted places by str.find in the normal form, with the smallest piece of the original that has the place's normal form."""
    normal, out = surfaces.normal_text(text), []
    for s in names:
        at, k = normal.find(s), 0
        while at >= 0:
            k, end = k + 1, at + len(s)
            bounded = not (at and token(normal[at - 1])) and not (end < len(normal) and token(normal[end]))
            out.append((s, k, at, end, bounded))
            at = normal.find(s, end)
    return sorted(out)


def test_normal_form_keeps_its_places():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randrange(14)))
        normal, starts, ends = surfaces.spanned(text)
        assert normal == surfaces.normal_text(text)
        assert len(normal) == len(starts) == len(ends) and list(starts) == sorted(starts) and list(ends) == sorted(ends)
        for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
            assert 0 <= a < b <= len(text)
            assert normal[k] == " " or normal[k] in surfaces.normal_text(text[a:b])


def test_occurrences_by_find():
    rng = random.Random(2)
    names = sorted({n for n in (surfaces.normal_text("".join(rng.choice(ODD) for _ in range(rng.randrange(1, 4)))) for _ in range(60)) if n})
    own, with_piece = surfaces.Automaton(names), 0
    for _ in range(1500):
        text = "".join(rng.choice(ODD) for _ in range(rng.randrange(30)))
        got = list(own.occurrences(text))
        assert sorted((s, k, a, b, bounded) for s, k, _, _, a, b, _, bounded in got) == by_hand(text, names)
        for s, _, start, end, _, _, matched, _ in got:
            if matched is not None:
                with_piece += 1
                assert text[start:end] == matched and surfaces.normal_text(matched) == s
    assert with_piece > 3000


@pytest.mark.parametrize(
    ("text", "surface", "want"),
    [
        ("Die STRASSE und die Straße", "strasse", [(1, 4, 11, "STRASSE"), (2, 20, 26, "Straße")]),
        ("café café CAFÉ", "café", [(1, 0, 5, "café"), (2, 6, 10, "café"), (3, 11, 15, "CAFÉ")]),
        ("שלום בון לבון", "בון", [(1, 5, 8, "בון")]),
        ("לבון ואז בון", "בון", [(2, 9, 12, "בון")]),
        ("בית־ספר", "בית", [(1, 0, 3, "בית")]),
        ("New\n  York‏, new york", "new york", [(1, 0, 10, "New\n  York"), (2, 13, 21, "new york")]),
        ("aaa a aa", "aa", [(2, 6, 8, "aa")]),
        ("ß", "s", []),
    ],
)
def test_places_in_the_original(spark, text, surface, want):
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "item_id long, text string")
    names = spark.createDataFrame([(surface,), ("",), ("x" * 300,)], "surface string")
    got = surfaces.accepted(surfaces.locate(df, names)).collect()
    assert sorted((r.ordinal, r.start, r.end, r.matched_text) for r in got) == want


def test_any_number_of_blocks_gives_the_same(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    texts = spark.createDataFrame([(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(40)], "item_id long, text string")
    names = spark.createDataFrame([(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 3))),) for _ in range(50)], "surface string").distinct()
    whole = sorted(surfaces.locate(texts, names).collect())
    assert len(whole) > 100 and whole == sorted(surfaces.locate(texts, names, block_chars=60).collect())
    assert surfaces.locate(texts, names.filter("false")).count() == 0
    assert surfaces.locate(texts.filter("false"), names).count() == 0


def test_hits_within_longer_ones_go(spark):
    rng = random.Random(4)
    hits = []
    for item in range(3):
        for k in range(60):
            a = rng.randrange(40)
            hits.append((item, f"s{k}", 1, a, a + (n := rng.randrange(1, 9)), a, a + n, "x"))
    hits += [(9, "ss", 1, 0, 1, 0, 2, "ß"), (9, "s", 1, 0, 1, 0, 1, "ß"), (9, "ss t", 1, 0, 3, 0, 4, "ß t")]
    df = spark.createDataFrame(hits, "item_id long, surface string, ordinal int, start int, end int, normal_start int, normal_end int, matched_text string")
    inside = lambda x, y: x[1] != y[1] and x[3:5] != y[3:5] and y[5] <= x[5] and x[6] <= y[6] and (y[5] < x[5] or x[6] < y[6])
    want = [h for h in hits if not any(inside(h, o) for o in hits if o[0] == h[0])]
    assert sorted(map(tuple, surfaces.uncovered(df).collect())) == sorted(want)
    pair = df.filter("item_id = 9 AND surface <> 'ss t'")
    assert pair.count() == surfaces.uncovered(pair).count() == 2  # the same piece of the original


def test_reasons_and_ambiguity_are_kept(spark):
    entities = spark.createDataFrame([(1, "Straße", "STRASSE"), (2, "strasse", "Weg"), (3, "Gone", "Gone"), (4, None, " ")], "entity_id long, canonical string, display string")
    aliases = spark.createDataFrame([(7, 1, "Gasse", "OCR"), (5, 1, "Strasse", None), (6, 1, "Strasse", None), (8, 3, "Weg", None)], "alias_id long, entity_id long, alias string, kind string")
    index = surfaces.surface_index(entities, aliases, spark.createDataFrame([(3,)], "entity_id long"))
    got = {r.surface: (r.ambiguous, [(e.entity_id, [tuple(x) for x in e.reasons]) for e in r.entities]) for r in index.collect()}
    assert got == {
        "strasse": (True, [(1, [("CANONICAL_NAME", "Straße", ""), ("DISPLAY_NAME", "STRASSE", ""), ("ALIAS", "Strasse", "")]), (2, [("CANONICAL_NAME", "strasse", "")])]),
        "gasse": (False, [(1, [("ALIAS", "Gasse", "OCR")])]), "weg": (False, [(2, [("DISPLAY_NAME", "Weg", "")])]),
    }
    texts = spark.createDataFrame([(1, "Die Straße, der Weg")], "item_id long, text string")
    found = sorted((r.surface, r.entity_id, r.ambiguous, r.start, len(r.reasons)) for r in surfaces.detected(texts, index).collect())
    assert found == [("strasse", 1, True, 4, 3), ("strasse", 2, True, 4, 1), ("weg", 2, False, 16, 1)]


def test_places_that_begin_within_a_folded_character(spark):
    got = {(s, k): (a, b, m, bounded) for s, k, a, b, _, _, m, bounded in surfaces.Automaton(["se"]).occurrences("Straße, se", exact=False)}
    assert got == {("se", 1): (4, 6, "ße", False), ("se", 2): (8, 10, "se", True)}
    texts = spark.createDataFrame([(1, "Straße, se")], "item_id long, text string")
    names = spark.createDataFrame([("se",)], "surface string")
    assert surfaces.accepted(surfaces.locate(texts, names)).count() == 0
    assert [(r.ordinal, r.start, r.matched_text) for r in surfaces.accepted(surfaces.locate(texts, names, exact=False)).collect()] == [(2, 8, "se")]


def test_queries_agree_with_sql_where_a_place_begins_within_a_folded_character(spark, tmp_path):
    import duckdb

    from folioforge import registry

    spark.createDataFrame([(1, "Die Straße, se viel. Masse"), (2, "Große  Gasse"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "se viel"), (1, "gasse in"), (2, "Strasse se")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("surface_occurrences", "surface_candidates"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        want = duck.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in df.columns)} FROM ({registry.ORACLES[name]})").fetchall()
        assert want and sorted(map(tuple, df.collect())) == sorted(want), name


def test_many_texts_are_walked_through_as_one(monkeypatch):
    rng = random.Random(5)
    names = sorted({n for n in (surfaces.normal_text("".join(rng.choice(ODD) for _ in range(rng.randrange(1, 4)))) for _ in range(60)) if n} | {"aa", "xx"})
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(30))) for _ in range(400)] + ["aaaaa xxaaa", " \n "]
    own, walks = surfaces.Automaton(names), []
    spanned = surfaces.Spanned
    monkeypatch.setattr(surfaces, "Spanned", lambda t: walks.append(len(t)) or spanned(t))
    x = own.places(texts)
    assert walks == [402]
    got = [[] for _ in texts]
    for k in range(len(x.text)):
        got[x.text[k]].append((names[x.surface[k]], x.ordinal[k], x.normal_start[k], x.normal_end[k], x.bounded[k]))
        if x.start[k] >= 0:
            assert surfaces.normal_text(texts[x.text[k]][x.start[k] : x.end[k]]) == names[x.surface[k]]
    assert [sorted(g) for g in got] == [by_hand(t, names) for t in texts] and (x.start >= 0).sum() > 1000
    assert sorted(by_hand("aaaaa xxaaa", ["aa"]))[-1] == ("aa", 3, 8, 10, False)


def test_places_agree_with_sql_in_texts_with_marks_and_folded_characters(spark, tmp_path):
    import duckdb

    from folioforge import registry

    rng = random.Random(6)
    parts = ["a", "é", "e", "ß", "SS", "s", " ", " ", "\n", "ש", "ׁ", ".", "-", "A", "x", "̣", "1", "se"]
    texts = [t for t in ("".join(rng.choice(parts) for _ in range(rng.randrange(2, 40))) for _ in range(300)) if unicodedata.is_normalized("NFC", t)]
    names = [" ".join("".join(rng.choice("aexs1é") for _ in range(rng.randrange(1, 3))) for _ in range(4)) for _ in range(30)]
    for t, rows, columns in (("documents", texts, "doc_id long, text string"), ("benchmark", names, "item_id long, text string")):
        spark.createDataFrame(list(enumerate(rows)), columns).write.parquet(f"{tmp_path}/{t}.parquet")
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    df = registry.QUERIES["surface_occurrences"](spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(f'{chr(34)}{c}{chr(34)}' for c in df.columns)} FROM ({registry.ORACLES['surface_occurrences']})").fetchall()
    assert len(want) > 1000 and sorted(map(tuple, df.collect())) == sorted(want)


def test_hits_are_not_shuffled_where_each_item_has_one_text(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(12)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    entities = spark.createDataFrame([(i, some(rng.randrange(1, 4)), some(1)) for i in range(60)], "entity_id long, canonical string, display string")
    index = surfaces.surface_index(entities, spark.createDataFrame([], "alias_id long, entity_id long, alias string, kind string"), entities.select("entity_id").filter("false"))
    rows = [(i, some(30)) for i in range(40)]
    for texts, blocks, once in ((rows, {}, True), (rows + [(i % 7, some(30)) for i in range(20)], {}, False), (rows, {"block_chars": 60}, False)):
        df = spark.createDataFrame(texts, "item_id long, text string").cache()
        got = surfaces.detected(df, index, **blocks)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [surface" in plan and ("Window" not in plan) is once
        columns = ["item_id", "surface", "ordinal", "start", "end", "entity_id"]
        want = surfaces.candidates(surfaces.uncovered(surfaces.accepted(surfaces.locate(df, index))), index).select(columns).collect()
        assert len(want) > 300 and sorted(got.select(columns).collect()) == sorted(want)
