import random

from folioforge.plans import proofs

SNAPSHOTS = "snapshot long, document long, status string, parser string, created long"
PAGES = "snapshot long, page long"
LINES = "snapshot long, page long, position long, line long, line_id string, contributes boolean, place string"


def plain(source, target, pages, lines):
    """The first refusal and its place, one check after the other."""
    none = (None, None)
    if source[1] != target[1]:
        return "DIFFERENT_DOCUMENT", *none
    if source[2] != "READY":
        return "SOURCE_NOT_READY", *none
    if target[2] != "READY":
        return "TARGET_NOT_READY", *none
    if source[3] != target[3]:
        return "PARSER_VERSION_MISMATCH", *none
    a, b = (sorted({p for s, p in pages if s == x[0]}) for x in (source, target))
    if a != b:
        return "PAGE_STRUCTURE_MISMATCH", min(set(a) ^ set(b)), None
    sides = []
    for x in (source, target):
        own, seen, place = {}, set(), {}
        for _, page, _, line, line_id, _, _ in sorted((r for r in lines if r[0] == x[0] and r[5]), key=lambda r: (r[1], r[2], r[3])):
            at = place[page] = place.get(page, 0) + 1
            name = (line_id or "").strip()
            if not name:
                return "MISSING_PROVIDER_LINE_ID", page, at
            if (page, name) in seen:
                return "DUPLICATE_PROVIDER_LINE_ID", page, at
            seen.add((page, name))
            own[page, at] = name, line
        sides.append(own)
    for at in sorted(set(sides[0]) ^ set(sides[1])):
        return "CONTRIBUTING_LINE_COUNT_MISMATCH", *at
    for at in sorted(sides[0]):
        if sides[0][at][0] != sides[1][at][0]:
            return "IDENTITY_SEQUENCE_MISMATCH", *at
    return None, *none


def test_all_refusals_and_places_equal_plain_checks(spark):
    rng = random.Random(11)
    snapshots = [(i, rng.choice([1, 1, 1, 1, None]), rng.choice(["READY"] * 9 + ["FAILED", None]), rng.choice(["v1"] * 6 + ["v2", None]), i // 2) for i in range(44)]
    pages, lines = [], []
    for i, *_ in snapshots:
        shown = [1, 2, 3] if rng.random() < 0.85 else rng.sample([1, 2, 3, 4], 2)
        pages += [(i, p) for p in shown]
        for p in shown:
            for k in range(3 if rng.random() < 0.95 else 2):
                name = rng.choice([None, " ", "l0", "y"]) if rng.random() < 0.05 else f" l{k}"
                lines.append((i, p, k // 2, i * 100 + p * 10 + k, name, True, "clash"))
            lines.append((i, p, 0, i * 100 + p * 10 + 9, None, False, None))
    snapshots += [(100, 1, "READY", "v1", 3), (101, 1, "READY", "v1", 9)]
    by = {s[0]: s for s in snapshots}
    pairs = [(a, b) for a in by for b in by if rng.random() < 0.4] + [(100, 101), (100, 101), (100, 999), (0, None)]
    made, corresponding = proofs.prove(
        spark.createDataFrame(pairs, "source long, target long"), spark.createDataFrame(snapshots, SNAPSHOTS), spark.createDataFrame(pages + pages[:4], PAGES), spark.createDataFrame(lines, LINES)
    )
    mine = {(r.source, r.target): (r.refusal, r.page, r.place) for r in made.collect()}
    want = {(a, b): plain(by[a], by[b], pages, lines) for a, b in pairs if a in by and b in by}
    assert mine == want and {w[0] for w in want.values()} == {None, *proofs.REFUSALS}
    good = {k for k, w in want.items() if w[0] is None}
    rows = corresponding.collect()
    assert {(r.source, r.target) for r in rows} == good - {(100, 101)}
    assert len(rows) == sum(len([x for x in lines if x[0] == a and x[5]]) for a, _ in good)
    assert all(r.source_line % 100 == r.target_line % 100 and r.source_line // 100 == r.source and r.target_line // 100 == r.target for r in rows)


def test_empty_tables(spark):
    empty = [spark.createDataFrame([], s) for s in ("source long, target long", SNAPSHOTS, PAGES, LINES)]
    made, corresponding = proofs.prove(*empty)
    assert made.count() == 0 and corresponding.count() == 0


def test_mappings_are_offered_newest_first(spark):
    snapshots = [(i, 1, "READY", "v1", t) for i, t in ((1, 5), (2, 7), (3, 7), (4, 9), (5, 9), (6, None), (7, 1))]
    pages = [(i, 1) for i in range(1, 8)]
    lines = [(i, 1, 0, i * 10, "odd" if i == 7 else "a", True, None) for i in range(1, 8)]
    mappings = [(70 + i, i) for i in (1, 2, 3, 4, 6, 7)]
    frame = spark.createDataFrame
    rows = proofs.transferable(frame([(4,), (4,), (6,), (1,)], "snapshot long"), frame(mappings, "mapping long, snapshot long"), frame(snapshots, SNAPSHOTS), frame(pages, PAGES), frame(lines, LINES))
    assert sorted((r.target, r.place, r.mapping, r.source) for r in rows.collect()) == [(4, 1, 73, 3), (4, 2, 72, 2), (4, 3, 71, 1)]
