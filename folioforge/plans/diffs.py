"""Plans: what a change would do, as rows with a status, before anything is applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import compatible, slug
from folioforge.operators.directory import with_places
from folioforge.sources.shared import cut


def drift(index: DataFrame, current: DataFrame, key: str, content: str) -> DataFrame:
    """(key, status): missing, extra, mismatch or ok, of an index against what it should hold."""
    a = index.select(key, F.col(content).alias("a"), F.lit(True).alias("in_index"))
    b = current.select(key, F.col(content).alias("b"), F.lit(True).alias("in_current"))
    status = F.when(F.col("in_index").isNull(), "missing").when(F.col("in_current").isNull(), "extra").when(~F.col("a").eqNullSafe(F.col("b")), "mismatch").otherwise("ok")
    return a.join(b, key, "full").select(key, status.alias("status"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`old` with the rows of `new` in place of those of the same key: a snapshot to write anew."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def orphans(listing: DataFrame, references: DataFrame, key: str, age: Column, limit: int | None = None) -> DataFrame:
    """Listed objects that nothing refers to and that are old enough, oldest first."""
    free = listing.join(references.select(key), key, "left_anti").filter(age).orderBy("modified", key)
    return free.limit(limit) if limit else free


def append_once(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """(operation_key, request, status) of a batch of operations: append, replay, or conflict. A blank key is no key.

    existing, batch: operation_key, request. Of one key within the batch the least request goes first.
    """
    named = F.length(F.trim(F.coalesce("operation_key", F.lit("")))) > 0
    first = batch.filter(named).groupBy("operation_key").agg(F.min("request").alias("first"))
    stored = existing.groupBy("operation_key").agg(F.min("request").alias("stored"))
    rows = batch.join(stored, "operation_key", "left").join(first, "operation_key", "left")
    held = F.coalesce("stored", "first")
    status = F.when(~named, "append").when(F.col("request") != held, "conflict").when(F.col("stored").isNotNull(), "replay").otherwise("append")
    return rows.select("operation_key", "request", status.alias("status"))


def mark_duplicates(rows: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """`rows` with a flag per key: every member of a group of two or more is marked. Groups are counted before they are joined."""
    for name, columns in keys.items():
        many = rows.groupBy(*columns).agg((F.count(F.lit(1)) > 1).alias(name))
        rows = rows.join(many, columns)
    return rows


def findings(**rules: Column) -> Column:
    """Names of the rules that a row breaks, in the order given; empty if it is eligible."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))


def numbered(base: Column, n: Column, size: int) -> Column:
    """base, base-2, base-3, …, cut so that the number fits."""
    suffix = F.concat(F.lit("-"), n.cast("string"))
    return F.when(n == 1, base).otherwise(F.concat(F.substring(base, F.lit(1), F.lit(size) - F.length(suffix)), suffix))


def unique_slugs(names: DataFrame, taken: DataFrame, size: int = 255) -> DataFrame:
    """(id, slug) of names (id, name) as if they came in id order: a base that is taken gets -2, -3, …, the first that is free.

    A name's number is its rank within the base, shifted by the numbers that the base cannot have: those of
    `taken` (slug), and those that an earlier name of another base has, as "a-2" is the base of "A 2" and the
    second slug of "a". The latter are found round by round, until no slug is given twice; a round costs a
    few joins, and without such names one is enough. Ids are distinct.
    """
    bases = names.select("id", slug(compatible(F.col("name")), size).alias("base"))
    ranked = cut(with_places(bases, ["id"], within=("base",)).withColumnRenamed("place", "rank"))
    number = F.regexp_extract("slug", "-([2-9]|[1-9]\\d{1,8})$", 1)
    stored = taken.select("slug").distinct()
    parted = stored.filter(number != "").select(F.regexp_replace("slug", "-\\d+$", "").alias("base"), number.cast("long").alias("n"))
    blocked = stored.select(F.col("slug").alias("base"), F.lit(1).cast("long").alias("n")).unionByName(parted)
    blocked = blocked.join(ranked.select("base").distinct(), "base", "left_semi").withColumn("since", F.lit(None).cast(ranked.schema["id"].dataType))
    while True:
        stored_too, since = F.max(F.col("since").isNull()), F.min("since")
        blocked = blocked.groupBy("base", "n").agg(F.when(~stored_too, since).alias("since"))
        # earlier names of the base are not kept from a number that only later ones cannot have
        earlier = blocked.join(ranked.select("base", "id"), "base").groupBy("base", "n").agg(F.count_if(F.col("id") < F.col("since")).alias("earlier"))
        kept = F.array_sort(F.collect_list(F.struct("n", "earlier")))
        fold = lambda a, x: F.when(x["n"] - F.size(a) > x["earlier"], F.array_append(a, x["n"])).otherwise(a)
        skips = earlier.groupBy("base").agg(F.aggregate(kept, F.array().cast("array<bigint>"), fold).alias("skips"))
        free = F.transform("skips", lambda x, i: x - i)  # free numbers up to each number that is skipped, itself included
        placed = ranked.join(skips, "base", "left").withColumn("n", F.col("rank") + F.coalesce(F.size(F.filter(free, lambda x: x <= F.col("rank"))), F.lit(0)))
        placed = cut(placed.select("id", "base", "n", numbered(F.col("base"), F.col("n"), size).alias("slug")))
        holders = placed.select("slug", "id").unionByName(stored.select("slug", F.lit(None).cast(ranked.schema["id"].dataType).alias("id")))
        owners = holders.groupBy("slug").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("id").isNull()).alias("stored"), F.min("id").alias("owner")).filter("k > 1")
        lost = placed.join(owners, "slug").filter(F.col("stored") | (F.col("id") != F.col("owner")))
        lost = cut(lost.select("base", "n", F.when(~F.col("stored"), F.col("owner")).alias("since")).distinct())
        if lost.isEmpty():
            return placed.select("id", "slug")
        blocked = cut(blocked.unionByName(lost))


def repoint(links: DataFrame, merges: DataFrame, key: str) -> DataFrame:
    """Distinct links with retired identities replaced by their keepers. merges: retired, target."""
    moved = links.join(merges.withColumnRenamed("retired", key), key, "left").withColumn(key, F.coalesce("target", key)).drop("target")
    return moved.distinct()


def merge_ordered(slots: DataFrame, keeper, duplicate) -> DataFrame:
    """Ordered slots (item_id, position, author_id) after a merge: a keeper that is linked keeps its slot, else the duplicate's becomes its own; positions from 0."""
    linked = F.max((F.col("author_id") == keeper).cast("int")).over(Window.partitionBy("item_id"))
    rows = slots.withColumn("linked", linked).filter(~((F.col("author_id") == duplicate) & (F.col("linked") == 1)))
    rows = rows.withColumn("author_id", F.when(F.col("author_id") == duplicate, F.lit(keeper)).otherwise(F.col("author_id")))
    place = F.row_number().over(Window.partitionBy("item_id").orderBy("position")) - 1
    return rows.select("item_id", place.alias("position"), "author_id")


def rename_joined(slots: DataFrame, names: DataFrame, size: int = 255) -> DataFrame:
    """(item_id, joined, too_long): names of an item's authors in order, joined by ", "."""
    rows = slots.join(names, "author_id").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("x"))
    joined = F.array_join(F.transform("x", lambda v: v["name"]), ", ")
    return rows.select("item_id", joined.alias("joined"), (F.length(joined) > size).alias("too_long"))


def apply_state(counters: DataFrame) -> DataFrame:
    """(state): ALREADY_APPLIED if all counters (name, found, approved) are no-ops, READY_TO_APPLY if they are as approved, else DRIFT."""
    state = F.when(F.bool_and(F.col("found") == 0), "ALREADY_APPLIED").when(F.bool_and(F.col("found") == F.col("approved")), "READY_TO_APPLY").otherwise("DRIFT")
    return counters.agg(state.alias("state"))


def merge_cycles(merges: DataFrame) -> DataFrame:
    """(cycle): least member of each cycle of a functional graph (retired, target), each cycle once, however long.

    Paths are followed by doubling: after k rounds a node knows the one 2**k steps on and the least on the
    way. Nodes whose path ends drop out; with 2**k >= nodes, whoever is reached is on a cycle and has seen all
    of it. Of several targets of one node the least counts.
    """
    steps = merges.groupBy(F.col("retired").alias("node")).agg(F.min("target").alias("to"))
    steps = cut(steps.filter("node IS NOT NULL AND to IS NOT NULL").withColumn("least", F.col("node")))
    n, reach = steps.count(), 1
    while True:
        on = steps.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("least").alias("other"))
        steps = cut(steps.join(on, "to").select("node", F.col("further").alias("to"), F.least("least", "other").alias("least")))
        reach *= 2
        if reach >= n:
            break
    return steps.join(steps.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select(F.col("least").alias("cycle")).distinct()
