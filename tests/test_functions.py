import datetime
import itertools
import random

import pytest
from pyspark.sql import functions as F

from folioforge.functions import dates, text
from folioforge.operators import matches, ordered, search


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "want"), [("שלום", "ש"), ("םםם", "מ"), ("  «abc", "A"), ("7 days", "#"), ("", "#"), (None, "#"), ("--éa", "É")]
)
def test_index_letter(spark, name, want):
    assert value(spark, text.index_letter(F.lit(name).cast("string"))) == want


@pytest.mark.parametrize(("raw", "want"), [("1:02:03", 3723), ("2:05", 125), ("90", 90), ("x", None), ("1:75", None), ("", None)])
def test_clock_seconds(spark, raw, want):
    assert value(spark, text.clock_seconds(F.lit(raw))) == want


def test_strings(spark):
    assert value(spark, text.ordered_names(F.lit(" a, b,,a ,c"))) == ["a", "b", "c"]
    assert value(spark, text.slug(F.lit("  Café & Bar!  "))) == "café-bar"
    assert value(spark, text.normal_whitespace(F.lit("a \t b\r\n\r\nc d "))) == "a b\n\nc d"
    assert value(spark, text.fold_dashes(F.lit("a–b—c"))) == "a-b-c"
    assert value(spark, text.reasons(F.lit('["x","y"]'))) == ["x", "y"] and value(spark, text.reasons(F.lit("plain"))) == ["plain"]
    assert value(spark, text.reasons(F.lit(None).cast("string"))) == []
    keys = [value(spark, text.sort_key(F.lit(n))) for n in ("«שם", "abc", "123", "")]
    assert [k.script for k in keys] == [0, 1, 2, 3] and keys[0].key == "שמ"


def test_date_bounds(spark):
    def both(p, y, m=None, d=None, y2=None):
        a = [F.lit(p)] + [F.lit(v).cast("int") for v in (y, m, d)]
        return value(spark, F.struct(dates.start_bound(*a).alias("a"), dates.end_bound(*a, F.lit(y2).cast("int")).alias("b")))

    d = datetime.date
    assert tuple(both("YEAR", 1950)) == (d(1950, 1, 1), d(1950, 12, 31))
    assert tuple(both("MONTH", 2020, 2)) == (d(2020, 2, 1), d(2020, 2, 29))
    assert tuple(both("DAY", 2020, 2, 30)) == (None, None) and tuple(both("MONTH", 2020, 13)) == (None, None)
    assert tuple(both("RANGE_YEAR", 1950, y2=1952)) == (d(1950, 1, 1), d(1952, 12, 31))
    assert tuple(both("UNKNOWN", 1950)) == (None, None)


def test_year_filter():
    assert dates.year_filter("1950", "1960") == (1950, 1960) and dates.year_filter("1950", None) == (1950, 1950)
    assert dates.year_filter("1960", "1950") == "reversed" and dates.year_filter("1960", "1950", strict=False) == (1960, 1960)
    assert dates.year_filter("x", None) == "from_invalid" and dates.year_filter("1950", "y", strict=False) == (1950, 1950)
    assert dates.year_filter(None, "1950") == "from_missing" and dates.year_filter("", None) is None and dates.year_filter("0", None) == "from_invalid"


def test_terms():
    assert search.terms("  The cat's ") == ["the", "cat", "s"] and search.terms("  ") is None and search.terms("x" * 201) == [] and search.terms("!!") == []


def test_snippets_prefer_distinct_terms_then_the_earliest_and_end_at_whole_words(spark):
    body = "alpha " + "xx " * 150 + "beta Alpha " + "yy " * 200 + "alpha beta"
    df = spark.createDataFrame([(1, body), (2, "none  here"), (3, None), (4, "word " * 100), (5, "alphabet")], "item_id long, text string")
    got = {r.item_id: r for r in matches.snippets(df, ["alpha", "beta"]).collect()}
    shown = got[1].snippet
    assert got[1].n_terms == 2 and "beta Alpha yy" in shown and shown.startswith("…x") and shown.endswith("y…") and 185 <= len(shown) <= 200
    assert (got[2].snippet, got[2].n_terms) == ("none here", 0) and got[3].snippet == "" and got[5].n_terms == 0
    assert got[4].snippet == ("word " * 100)[:190] + "…"
    parts = matches.segments(spark.createDataFrame([(1, "beta and ALPHA, alphabet")], "item_id long, snippet string"), ["alpha", "beta"]).orderBy("place").collect()
    assert [(r.part, r.is_match) for r in parts] == [("beta", True), (" and ", False), ("ALPHA", True), (", alphabet", False)]
    ranges = matches.literal_ranges(spark.createDataFrame([(1, "Aaaa aA"), (2, "İaa")], "item_id long, text string"), ["item_id"], ["AA", "aa"])
    assert sorted((r.item_id, r.start, r.end) for r in ranges.collect()) == [(1, 0, 2), (1, 2, 4), (1, 5, 7)], "a text whose lower case is longer has none"


def test_bands_by_full_enumeration():
    rng = random.Random(1)
    for _ in range(200):
        y, lines = 0, []
        for _ in range(rng.randrange(1, 9)):
            y += rng.randrange(0, 30)
            h = rng.randrange(1, 25)
            lines.append((y, y + h))
            y += h
        n, height = len(lines), rng.randrange(60, 300)
        want = None
        for k in range(1, min(6, n) + 1):
            plans = []
            for cuts in itertools.combinations(range(1, n), k - 1):
                edges = (0, *cuts, n)
                if all(lines[b - 1][1] - lines[a][0] <= 0.35 * height for a, b in itertools.pairwise(edges)):
                    plans.append((sorted(-(lines[c][0] - lines[c - 1][1]) for c in cuts), list(cuts)))
            if plans:
                want = min(plans)[1]
                break
        assert ordered.plan_bands(lines, height) == want


def test_geometry(spark):
    assert [tuple(p) for p in value(spark, ordered.polygon(F.lit("0,0 10,0 10,5")))] == [(0, 0), (10, 0), (10, 5)]
    assert value(spark, ordered.polygon(F.lit("0,0 10"))) is None and value(spark, ordered.polygon(F.lit("0,0 1,1"))) is None
    assert tuple(value(spark, ordered.bounding_box(ordered.polygon(F.lit("3,4 10,0 7,5"))))) == (3, 0, 10, 5)
    assert [value(spark, ordered.clamp(F.lit(v), F.lit(100))) for v in (-5, -6, 105, 106, 50)] == [0, None, 100, None, 50]
    assert value(spark, ordered.box_percent(*[F.lit(v) for v in (0, 0, 50, 20, 100, 200)]))["height"] == 10.0
    assert value(spark, ordered.box_percent(*[F.lit(v) for v in (0, 0, 500, 20, 100, 200)])) is None
    merged = ordered.merge_overlap(F.array(*map(F.lit, "abcd")), F.array(*map(F.lit, "cdef")))
    assert value(spark, merged) == list("abcdef")
    halves = value(spark, ordered.page_halves(F.lit(100), F.lit(1000)))
    assert [(h.top, h.bottom) for h in halves] == [(0, 550), (450, 1000)] and value(spark, ordered.page_halves(F.lit(100), F.lit(50))) is None


def test_slugs_keep_letters_of_all_scripts(spark):
    """By the plain rule: compatibility form, lower case, letters, digits, underscores, blanks and hyphens; then single hyphens."""
    import re
    import unicodedata

    names = ["בית ספר", "בית־ספר", "Müller & Sohn", "Straße 5", "ﬁne  print", "a_b", "--x__", "½ cup", "", None, "!?", "日本語 テスト", "ŉ x", "a\u00a0b\u2003c", "É" * 300]
    for name in names:
        kept = re.sub(r"[^\w\s-]", "", unicodedata.normalize("NFKC", name or "").lower())
        want = re.sub(r"[-\s]+", "-", kept).strip("-_")[:255] or "item"
        row = spark.createDataFrame([(name,)], "name string").select(text.slug(text.compatible("name")).alias("s")).first()
        assert row.s == want, name


def test_maqaf_is_no_dash_and_all_long_dashes_are_one(spark):
    assert value(spark, text.fold_dashes(F.lit("בית־ספר a−b a﹣b a﹘b a－b"))) == "בית־ספר a-b a-b a-b a-b"


def test_sort_keys_by_plain_code(spark):
    import unicodedata

    def plain(name):
        t = unicodedata.normalize("NFC", name).translate({ord(c): "-" for c in text.DASHES})
        t = " ".join(t.split()).casefold().translate(str.maketrans(text.FINALS, text.ORDINARY))
        while t and (t[0].isspace() or unicodedata.category(t[0])[0] in "MPSC"):
            t = t[1:]
        if not t:
            return 3, ""
        c = ord(t[0])
        return (0 if 0x590 <= c <= 0x5FF else 1 if "a" <= t[0] <= "z" or 0xC0 <= c <= 0x24F or 0x1E00 <= c <= 0x1EFF else 2), t

    names = ["«שלום־ם", "Straße", "Ｆull", "é", "É x", "123", "–", "", "  a–b  c ", "Ωmega", "־בית"]
    rows = spark.createDataFrame([(n,) for n in names], "name string").select("name", text.sort_key(text.folded("name")).alias("k")).collect()
    assert {r.name: (r.k.script, r.k.key) for r in rows} == {n: plain(n) for n in names}
