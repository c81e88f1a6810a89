import hashlib
import itertools
import random
import re
from functools import cache

import pytest

from folioforge.llm import repair
from tests.llm.conftest import crc

KIND = "conv_id long, turn long, role string, text string, part int, place string, fate int, audit string, state int"
NONE = hashlib.sha256(b"").hexdigest()


def exhaustive(initials, faults):
    """(cost, audit) by trying all edits, and up to two insertions at every place."""
    gaps = [("", ""), *[("I" * len(x), x) for x in ("u", "a", "ua", "au", "uu", "aa")]]
    found = []
    for inserted in itertools.product(gaps, repeat=len(initials) + 1):
        for edits in itertools.product(("K", "Ru", "Ra", "D"), repeat=len(initials)):
            if any(e != "D" and f in ("blank", "duplicate") for e, f in zip(edits, faults, strict=True)):
                continue
            audit, shown, cost = inserted[0][0], inserted[0][1], 0
            for e, f, i, (many, more) in zip(edits, faults, initials, inserted[1:], strict=True):
                cost += {"K": 0, "R": 2, "D": 3}[e[0]] + (e != "D" and f == "truncated")
                audit += e[0] + many
                shown += ({"K": i, "D": ""}.get(e[0], e[1:])) + more
            if re.fullmatch("(s?(ua)+)?", shown):
                found.append((cost + 2 * audit.count("I"), audit))
    return min(found)


def backwards(initials, faults):
    """(cost, audit) by memoised recursion from each turn on."""

    @cache
    def best(at, state):
        found = [(0, "")] if at == len(initials) and state in (0, 3) else []
        after = lambda x: {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, x))
        if at < len(initials):
            if faults[at] not in ("blank", "duplicate"):
                extra = faults[at] == "truncated"
                ways = [("K", extra, after(initials[at])), *[("R", 2 + extra, after(x)) for x in "ua"]]
                found += [(c + cost, e + audit) for e, c, s in ways if s is not None for cost, audit in [best(at + 1, s)]]
            cost, audit = best(at + 1, state)
            found.append((3 + cost, "D" + audit))
        if (at, state) not in held:
            held.add((at, state))
            found += [(2 + cost, "I" + audit) for x in "ua" if after(x) is not None for cost, audit in [best.__wrapped__(at, after(x))]]
            held.discard((at, state))
        return min(found, default=(1 << 40, ""))

    held = set()
    for at in reversed(range(len(initials))):  # from the end, so that no recursion is deep
        for state in range(4):
            best(at, state)
    return best(0, 0)


def by_hand(rows):
    """The query's rows for rows (conv_id, turn, role, text), one conversation after the other."""
    nul = lambda x: " " if x is None else x
    convs = {}
    for conv, turn, role, text in rows:
        own = convs.setdefault(conv, [])
        fate, role, text = crc(f"{nul(conv)}:{nul(turn)}") % 20, nul(role), nul(text)
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            own += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in own:
            plain = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not plain else "duplicate" if (role, text) in seen else "truncated" if plain[-1] not in ".!?" else "ok")
            seen.add((role, text))
        initials = [r[1][:1] for r in own]
        cost, audit = backwards(initials, tuple(faults))
        lines, at, state = [], 0, ""
        for e in audit:
            role, text = (None, "") if e == "I" else own[at][1:]
            at += e != "I"
            if e != "D":
                role = role if e == "K" else "user" if state in ("", "s", "a") else "assistant"
                state = role[0]
                lines.append(f"{role}:{text}")
        numbers = {r[0] for r in own if r[0] is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        out.append((conv, gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], KIND)


def got(spark, rows):
    return sorted(map(tuple, repair.damaged_and_repaired(table(spark, rows)).collect()), key=str)


def test_parse_is_the_cheapest_of_all_edits():
    rng = random.Random(1)
    cases = [list(x) for n in range(3) for x in itertools.product("suax", repeat=n)] + [[rng.choice("suax ") for _ in range(3)] for _ in range(12)]
    for initials in cases:
        faults = [rng.choice(["ok", "ok", "blank", "duplicate", "truncated"]) for _ in initials]
        column = repair.parse(initials, faults)
        assert min(column[s] for s in repair.DONE if s in column) == exhaustive(initials, faults) == backwards(initials, tuple(faults)), (initials, faults)


def test_agrees_with_plain_code_on_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, repair.query(spark, "/root/testdata/sf0.001").collect()), key=str) == by_hand(rows)


@pytest.mark.parametrize("part", [2, 512])
def test_awkward_conversations(spark, monkeypatch, part):
    monkeypatch.setattr(repair, "PART_TURNS", part)
    rng = random.Random(2)
    texts = ["Yes.", "Why?", "no end", " \t", "", None, "日本語 😀!", "tail. \n", "a:b\nc."]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(texts)) for c in [*range(40), None] for t in range(rng.randrange(1, 12))]
    rows += [(50, None, "user", "Hi."), (50, None, "user", "Hi."), (50, 3, "assistant", "Ho."), (50, 3, "assistant", "Ha."), (50, 9, "system", "x")]
    rows += rows[:9]
    assert got(spark, rows) == by_hand(rows)


def test_a_long_conversation_is_many_parts(spark):
    rng = random.Random(3)
    rows = [(7, t, rng.choice(["user", "assistant"]), rng.choice(["Long.", "Longer!", f"text {t}.", "cut"])) for t in range(2500)]
    assert got(spark, rows) == by_hand(rows)


def test_nothing_is_left(spark):
    gone = next(t for t in range(1000) if crc(f"1:{t}") % 20 == 0)
    blank = next(t for t in range(1000) if crc(f"2:{t}") % 20 == 1)
    assert got(spark, [(1, gone, "user", "Hi."), (2, blank, "user", "Hi.")]) == [(1, 0, 0, 0, 0, 0, 0, "", NONE), (2, 0, 1, 0, 0, 0, 3, "D", NONE)]
    assert got(spark, []) == []


def test_edits_are_rows_and_ids_may_be_text(spark):
    df = spark.createDataFrame([("c", 1, "assistant", "One."), ("c", 2, "assistant", "Two."), ("c", 3, "user", "")], "conv string, n int, who string, said string")
    report, edits = repair.repaired(df, conv_col="conv", turn_col="n", role_col="who", text_col="said")
    assert [tuple(r) for r in report.collect()] == [("c", 0, 1, 0, 0, 1, 5, "RKD")]
    assert [tuple(r) for r in edits.orderBy("part", "step").collect()] == [("c", 0, 0, "R", "user", "One."), ("c", 0, 1, "K", "assistant", "Two."), ("c", 0, 2, "D", "user", "")]
