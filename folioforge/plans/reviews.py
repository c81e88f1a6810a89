"""Reviews, backfills and remaps: classified rows and their errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.operators.directory import with_places
from folioforge.sources.shared import cut


def link_plan(photo_links: DataFrame, photos: DataFrame, item_links: DataFrame) -> DataFrame:
    """(photo_id, person_id, status) per photo link: ERROR without a parent item, NOOP where the item has the person, else CREATE."""
    parents = photo_links.join(photos.select("photo_id", "item_id"), "photo_id", "left")
    known = item_links.select("item_id", "person_id", F.lit(True).alias("known")).distinct()
    status = F.when(F.col("item_id").isNull(), "ERROR").when(F.col("known"), "NOOP").otherwise("CREATE")
    return parents.join(known, ["item_id", "person_id"], "left").select("photo_id", "person_id", status.alias("status"))


def merge_errors(rows: DataFrame) -> DataFrame:
    """(id, error) of merge reviews (id, status, canonical, target): missing target, self, absent, target not approved, other canonical name; null if none."""
    targets = rows.select(F.col("id").alias("__id"), F.col("status").alias("target_status"), F.col("canonical").alias("target_canonical"))
    merges = rows.filter(F.col("status") == "MERGE").join(targets, F.col("target") == F.col("__id"), "left")
    error = (
        F.when(F.col("target").isNull(), "missing_target").when(F.col("target") == F.col("id"), "self").when(F.col("__id").isNull(), "absent")
        .when(F.col("target_status") != "APPROVE", "not_approved").when(~F.col("canonical").eqNullSafe(F.col("target_canonical")), "canonical")
    )
    return merges.select("id", error.alias("error"))


def import_plan(operations: DataFrame, existing: DataFrame, key: str, content: str) -> DataFrame:
    """(key, status) of wanted rows against existing ones: ADD, REPAIR or NOOP."""
    now = existing.select(key, F.col(content).alias("__now"), F.lit(True).alias("__there"))
    status = F.when(F.col("__there").isNull(), "ADD").when(F.col(content).eqNullSafe(F.col("__now")), "NOOP").otherwise("REPAIR")
    return operations.join(now, key, "left").select(key, status.alias("status"))


def remap(breaks: DataFrame, mapping: DataFrame) -> DataFrame:
    """(snapshot, targets) of line breaks (snapshot, line_id) through a mapping (snapshot, line_id, target); null where a break has no target or two share one."""
    joined = breaks.join(mapping, ["snapshot", "line_id"], "left")
    good = (F.count_if(F.col("target").isNull()) == 0) & (F.countDistinct("target") == F.count(F.lit(1)))
    return joined.groupBy("snapshot").agg(F.when(good, F.array_sort(F.collect_list("target"))).alias("targets"))


def earlier(snapshots: DataFrame, most: int | None = None) -> DataFrame:
    """(newer, older, place): the older snapshots of each snapshot's document (snapshot_id, document_id, created), newest first, all or the first `most`.

    Snapshots of one moment are not older than each other. Places within the document come from ranges, and a
    snapshot meets the places before its own in an equi join, so that a document of very many snapshots is
    many tasks; the result has a row for each pair, which a caller bounds by `most`.
    """
    placed = with_places(snapshots.select("snapshot_id", "document_id", "created"), [F.col("created"), F.desc("snapshot_id")], within=("document_id",))
    placed = cut(placed)
    moments = placed.groupBy("document_id", "created").agg((F.min("place") - 1).alias("before"))
    first = F.greatest(F.lit(1), F.col("before") - most + 1) if most is not None else F.lit(1).cast("long")
    newer = placed.drop("place").join(moments, ["document_id", "created"]).filter("before > 0")
    newer = newer.select("document_id", F.col("snapshot_id").alias("newer"), "before", F.explode(F.sequence(first, F.col("before"))).alias("place"))
    joined = newer.join(placed.select("document_id", "place", F.col("snapshot_id").alias("older")), ["document_id", "place"])
    return joined.select("newer", "older", (F.col("before") - F.col("place") + 1).cast("int").alias("place"))


def candidates(names: DataFrame, persons: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, person_id): persons whose name or alias is one of the names, case and blanks at the ends ignored."""
    fold = lambda c: F.lower(F.trim(c))
    known = persons.select(fold(F.col("name")).alias("k"), "person_id").unionByName(aliases.select(fold(F.col("alias")).alias("k"), "person_id"))
    return names.select("name", fold(F.col("name")).alias("k")).join(known, "k").select("name", "person_id").distinct()


def capability(lines: DataFrame) -> DataFrame:
    """(page, lines, valid, duplicate_ids, out_of_bounds, capability) of geometry (page, line_id, x0, y0, x1, y1, width, height); one aggregate."""
    inside = (F.col("x0") >= 0) & (F.col("y0") >= 0) & (F.col("x1") <= F.col("width")) & (F.col("y1") <= F.col("height"))
    solid = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))
    n, good = F.count(F.lit(1)), F.count_if(inside & solid)
    state = F.when(good == n, "FULL").when(good > 0, "PARTIAL").otherwise("NONE")
    return lines.groupBy("page").agg(
        n.alias("lines"), good.alias("valid"), (F.count("line_id") - F.countDistinct("line_id")).alias("duplicate_ids"), F.count_if(~inside).alias("out_of_bounds"), state.alias("capability")
    )


def document_capability(pages: DataFrame, document: Column) -> DataFrame:
    """(document, capability): that of all its pages if they agree, else MIXED."""
    return pages.groupBy(document.alias("document")).agg(F.when(F.min("capability") == F.max("capability"), F.min("capability")).otherwise("MIXED").alias("capability"))


def segments(lines: DataFrame) -> DataFrame:
    """(snapshot, start, end, kind) that cover a text: its lines and the gaps between them; a text whose lines overlap gives no rows.

    lines: snapshot, char_start, char_end. A snapshot's lines are one window group.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("snapshot").orderBy("char_start", "char_end")
    linked = lines.withColumn("before", F.coalesce(F.lag("char_end").over(order), F.lit(0)))
    bad = linked.filter(F.col("char_start") < F.col("before")).select("snapshot").distinct()
    good = linked.join(bad, "snapshot", "left_anti")
    own = good.select("snapshot", F.col("char_start").alias("start"), F.col("char_end").alias("end"), F.lit("line").alias("kind"))
    gaps = good.filter(F.col("char_start") > F.col("before")).select("snapshot", F.col("before").alias("start"), F.col("char_start").alias("end"), F.lit("gap").alias("kind"))
    return own.unionByName(gaps)


def representatives(members: DataFrame, most: int = 4) -> DataFrame:
    """(group, member, role) of up to `most` members (group, item_id, ordinal, unusual): the first, the last, an unusual one, then members of further items.

    First, last and unusual are aggregates; of the items' first members only so many are ordered as may be chosen.
    """
    from pyspark.sql import Window

    at = F.struct("item_id", "ordinal")
    ends = members.groupBy("group").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.min(F.when(F.col("unusual"), at)).alias("unusual"))
    roles = ("first", "last", "unusual")
    named = ends.select("group", F.explode(F.array(*[F.struct(F.lit(k).alias("rank"), F.col(r).alias("at")) for k, r in enumerate(roles)])).alias("x")).filter("x.at IS NOT NULL")
    by = Window.partitionBy("group").orderBy("item_id", "ordinal")
    items = members.groupBy("group", "item_id").agg(F.min("ordinal").alias("ordinal")).withColumn("__n", F.row_number().over(by)).filter(F.col("__n") <= most + len(roles))
    new = items.select("group", F.struct(F.lit(len(roles)).alias("rank"), at.alias("at")).alias("x"))
    # a member has the first of its roles
    once = named.unionByName(new).groupBy("group", "x.at").agg(F.min("x.rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("group").orderBy("rank", "at"))
    role = F.get(F.array(*map(F.lit, (*roles, "new_item"))), F.col("rank"))
    return once.withColumn("__n", place).filter(F.col("__n") <= most).select("group", "at.item_id", "at.ordinal", role.alias("role"))


def single_target(rows: DataFrame, key: str, target: str) -> DataFrame:
    """(key, target, error): a key's one target; `ambiguous` where it has several."""
    return rows.groupBy(key).agg(F.min(target).alias(target), F.when(F.countDistinct(target) > 1, "ambiguous").alias("error"))


def merge_preview(links: DataFrame, pending: DataFrame, merges: DataFrame) -> DataFrame:
    """(retired, target, moved, dropped, blockers) of proposed merges (retired, target).

    links: identity, item_id. pending: identity, item_id, action. moved: links that go to the keeper;
    dropped: those it has already; blockers: suggestions of one action that both have for one item.
    """
    own = merges.join(links.withColumnRenamed("identity", "retired"), "retired", "left")
    kept = links.select(F.col("identity").alias("target"), "item_id", F.lit(True).alias("there")).distinct()
    counted = own.join(kept, ["target", "item_id"], "left").groupBy("retired", "target").agg(
        F.count_if(F.col("item_id").isNotNull() & F.col("there").isNull()).alias("moved"), F.count_if(F.col("there")).alias("dropped")
    )
    mine = merges.join(pending.withColumnRenamed("identity", "retired"), "retired")
    both = mine.join(pending.withColumnRenamed("identity", "target"), ["target", "item_id", "action"], "left_semi").groupBy("retired", "target").agg(F.count(F.lit(1)).alias("blockers"))
    return counted.join(both, ["retired", "target"], "left").withColumn("blockers", F.coalesce("blockers", F.lit(0)))


def overlap_reasons(proposals: DataFrame) -> DataFrame:
    """`proposals` with `reason`, the first that forbids its cleanup, or `eligible`.

    proposals: sha, current_sha, version, accepted, contained, all_pending, authoritative, detected (booleans but the first three).
    """
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    # The reasons, which reviewers read.
    reason = (
        F.when(~F.col("sha").eqNullSafe(F.col("current_sha")), "stale_source").when(~F.col("version").eqNullSafe(F.lit(1)), "wrong_normalization_version").when(no("accepted"), "not_currently_accepted")
        .when(no("contained"), "not_contained").when(no("all_pending"), "mixed_or_nonpending_status").when(~no("authoritative"), "has_authoritative_occurrence").when(no("detected"), "missing_detect_event").otherwise("eligible")
    )
    return proposals.withColumn("reason", reason)


def lineages(runs: DataFrame) -> DataFrame:
    """(document, collection, model, runs, remotes, shared, verified) of upload runs (document, collection, model, remote, verified); shared: a remote id that another lineage has too."""
    key = ["document", "collection", "model"]
    owners = runs.filter("remote IS NOT NULL").groupBy("remote").agg((F.countDistinct(*key) > 1).alias("is_shared"))
    rows = runs.join(owners, "remote", "left")
    return rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("runs"), F.countDistinct("remote").alias("remotes"), F.bool_or(F.coalesce("is_shared", F.lit(False))).alias("shared"), F.bool_or("verified").alias("verified")
    )


def version_audit(versions: DataFrame) -> DataFrame:
    """(page, original, non_matching, insufficient): ids of a page's transcript versions (page, version, sha, original_sha) by class, ascending."""
    kind = F.when(F.col("sha").isNull() | F.col("original_sha").isNull(), "insufficient").when(F.col("sha") == F.col("original_sha"), "original").otherwise("non_matching")
    listed = lambda name: F.array_sort(F.collect_list(F.when(kind == name, F.col("version")))).alias(name)
    return versions.groupBy("page").agg(*[listed(n) for n in ("original", "non_matching", "insufficient")])
