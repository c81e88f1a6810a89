"""Proofs that the lines of two snapshots correspond one to one, so that breaks of one may be carried to the other.

Two numbered sequences meet in a full outer join by page and place. What speaks against a pair is ordered by a
level and then by page and place, and the least is the refusal. Lines move only for pairs against which nothing
that is known without them speaks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.directory import with_places
from folioforge.sources.shared import cut

# Reasons of a refusal, in the order in which they are looked for.
REFUSALS = (
    "DIFFERENT_DOCUMENT", "SOURCE_NOT_READY", "TARGET_NOT_READY", "PARSER_VERSION_MISMATCH", "PAGE_STRUCTURE_MISMATCH",
    "MISSING_PROVIDER_LINE_ID", "DUPLICATE_PROVIDER_LINE_ID", "CONTRIBUTING_LINE_COUNT_MISMATCH", "IDENTITY_SEQUENCE_MISMATCH",
)
READY = "READY"
PAIR = ["source", "target"]
_AT = "struct<level:int,page:bigint,place:bigint,refusal:string>"


def _fault(level: int, page, place, refusal):
    refusal = F.lit(refusal) if isinstance(refusal, str) else refusal
    return F.struct(F.lit(level).alias("level"), page.cast("long").alias("page"), place.cast("long").alias("place"), refusal.alias("refusal")).cast(_AT)


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(snapshot, page, place, line, line_id, position) of the lines that contribute, numbered within their page by position and line; ids are trimmed, null ones blank."""
    own = lines.filter("contributes").select("snapshot", "page", "line", F.trim(F.coalesce("line_id", F.lit(""))).alias("line_id"), "position")
    return cut(with_places(own, ["position", "line"], within=("snapshot", "page")))


def id_faults(placed: DataFrame) -> DataFrame:
    """(snapshot, page, place, refusal): of the numbered lines of each snapshot the first that has no id, or one that a line of its page before it has."""
    first = placed.groupBy("snapshot", "page", "line_id").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND line_id <> ''")
    again = placed.join(first.drop("n"), ["snapshot", "page", "line_id"]).filter("place > first").select("snapshot", "page", "place", F.lit(REFUSALS[6]).alias("refusal"))
    blank = placed.filter("line_id = ''").select("snapshot", "page", "place", F.lit(REFUSALS[5]).alias("refusal"))
    return again.unionByName(blank).groupBy("snapshot").agg(F.min(F.struct("page", "place", "refusal")).alias("x")).select("snapshot", "x.*")


def _meet(pairs: DataFrame, rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The rows of both snapshots of each pair by `keys`, those of the source under `a`, of the target under `b`."""
    side = lambda own, name: pairs.join(rows.select(F.col("snapshot").alias(own), *keys, F.struct(*values).alias(name)), own)
    return side("source", "a").join(side("target", "b"), [*PAIR, *keys], "full")


def prove(pairs: DataFrame, snapshots: DataFrame, pages: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(proofs, correspondence) of pairs (source, target) of snapshots.

    snapshots: snapshot, document, status, parser. pages: snapshot, page. lines: snapshot, page, position,
    line, line_id, contributes. A proof (source, target, refusal, page, place) has the first reason of
    REFUSALS that speaks against the pair, those of ids in the order source, target and within a snapshot the
    first of both, and where it is: page and place of a line, the first page that only one of both has, nothing
    of what comes before. Null refusal: the lines correspond. Then, and only then, each line of the source has a
    row (source, target, page, place, line_id, source_line, target_line, source_position, target_position).

    Repeated pairs count once, those with an unknown snapshot are left out; a snapshot without pages or lines
    corresponds to another. Nulls of document or parser equal each other, a null status is not ready.
    """
    none = F.lit(None)
    known = lambda own, name: snapshots.select(F.col("snapshot").alias(own), F.struct("document", "status", "parser").alias(name))
    met = pairs.select(*PAIR).distinct().join(known("source", "s"), "source").join(known("target", "t"), "target")
    early = (
        F.when(~F.col("s.document").eqNullSafe(F.col("t.document")), _fault(1, none, none, REFUSALS[0]))
        .when(~F.col("s.status").eqNullSafe(READY), _fault(2, none, none, REFUSALS[1]))
        .when(~F.col("t.status").eqNullSafe(READY), _fault(3, none, none, REFUSALS[2]))
        .when(~F.col("s.parser").eqNullSafe(F.col("t.parser")), _fault(4, none, none, REFUSALS[3]))
    )
    headed = cut(met.select(*PAIR, early.alias("fault")))
    alike = headed.filter("fault IS NULL").select(*PAIR)

    page_places = with_places(pages.select("snapshot", "page").distinct(), ["page"], within=("snapshot",))
    structure = _meet(alike, page_places, ["place"], ["page"]).filter(~F.col("a.page").eqNullSafe(F.col("b.page")))
    fault = _fault(5, F.least("a.page", "b.page"), none, REFUSALS[4])
    structure = structure.groupBy(*PAIR).agg(F.min_by(fault, "place").alias("fault"))

    placed = numbered_lines(lines)
    bad = cut(id_faults(placed))
    faults_of = lambda own, level: alike.join(bad.withColumnRenamed("snapshot", own), own).select(*PAIR, _fault(level, F.col("page"), F.col("place"), F.col("refusal")).alias("fault"))
    before = headed.unionByName(structure).unionByName(faults_of("source", 6)).unionByName(faults_of("target", 7))
    before = cut(before.groupBy(*PAIR).agg(F.min("fault").alias("fault")))

    open_pairs = before.filter("fault IS NULL").select(*PAIR)
    joined = cut(_meet(open_pairs, placed, ["page", "place"], ["line", "line_id", "position"]))
    lone = F.col("a").isNull() | F.col("b").isNull()
    late = F.when(lone, _fault(8, F.col("page"), F.col("place"), REFUSALS[7])).when(F.col("a.line_id") != F.col("b.line_id"), _fault(9, F.col("page"), F.col("place"), REFUSALS[8]))
    late = joined.select(*PAIR, late.alias("fault")).filter("fault IS NOT NULL")
    least = cut(before.unionByName(late).groupBy(*PAIR).agg(F.min("fault").alias("fault")))

    proofs = least.select(*PAIR, "fault.refusal", "fault.page", "fault.place")
    good = least.filter("fault IS NULL").select(*PAIR)
    sides = [F.col("a.line").alias("source_line"), F.col("b.line").alias("target_line"), F.col("a.position").alias("source_position"), F.col("b.position").alias("target_position")]
    return proofs, joined.join(good, PAIR, "left_semi").select(*PAIR, "page", "place", F.col("a.line_id").alias("line_id"), *sides)


def transferable(targets: DataFrame, mappings: DataFrame, snapshots: DataFrame, pages: DataFrame, lines: DataFrame) -> DataFrame:
    """(target, mapping, source, place): the mappings (mapping, snapshot) of older snapshots whose lines correspond to those of a target (snapshot), newest snapshot first, of one moment the larger id first.

    snapshots have `created` beside what `prove` takes. Nothing is adopted, and a mapping of the target's own
    does not matter; a snapshot of the same moment, or of an unknown one, is not older.
    """
    held = mappings.select("mapping", F.col("snapshot").alias("source")).join(snapshots.select(F.col("snapshot").alias("source"), "document", F.col("created").alias("at")), "source")
    wanted = targets.select(F.col("snapshot").alias("target")).distinct().join(snapshots.select(F.col("snapshot").alias("target"), "document", F.col("created").alias("until")), "target")
    older = cut(held.join(wanted, "document").filter("at < until").select("target", "mapping", "source", "at"))
    proofs, _ = prove(older.select(*PAIR), snapshots, pages, lines)
    fit = older.join(proofs.filter("refusal IS NULL").select(*PAIR), PAIR)
    return with_places(fit, [F.desc("at"), F.desc("source"), F.col("mapping")], within=("target",)).select("target", "mapping", "source", "place")
