"""Identity directories: holdings, unions of identities, letters, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import index_letter
from folioforge.sources.shared import cut


def holdings(pairs: DataFrame) -> DataFrame:
    """(identity, item_type, n) of distinct (identity, item); an item of several types counts as its first."""
    one = pairs.groupBy("identity", "item_id").agg(F.min("item_type").alias("item_type"))
    return one.groupBy("identity", "item_type").agg(F.count(F.lit(1)).alias("n"))


def holdings_summary(counts: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """(identity, summary): the counts over zero in a fixed order of types, "2 photos · 1 video"."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("item_type"))
    part = F.concat(F.col("n").cast("string"), F.lit(" "), F.lower("item_type"), F.when(F.col("n") == 1, "").otherwise("s"))
    parts = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct(rank.alias("rank"), part.alias("part")))))
    return counts.groupBy("identity").agg(F.array_join(F.transform(parts, lambda p: p["part"]), " · ").alias("summary"))


def union_directory(persons: DataFrame, authors: DataFrame) -> DataFrame:
    """(name, kind_rank, id) of persons and of authors without a linked person."""
    free = authors.join(persons.select(F.col("id").alias("person_id")), "person_id", "left_anti")
    return persons.select("name", F.lit(0).alias("kind_rank"), "id").unionByName(free.select("name", F.lit(1).alias("kind_rank"), "id"))


def with_places(rows: DataFrame, order: list[str], within: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with `place`, 1.. in a total order, of all rows or of those with the same `within`, and no task that sorts them all.

    Rows are range-partitioned and sorted, and numbered by the rows of the ranges before and a count within
    their own. The ranges are checkpointed before they are numbered, so that both readings see the same.
    """
    ranged = rows.repartitionByRange(*within, *order).sortWithinPartitions(*within, *order)
    ids = F.monotonically_increasing_id()
    marked = cut(ranged.withColumn("__part", F.shiftright(ids, 33)).withColumn("__at", ids.bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = marked.groupBy(*within, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*within, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__offset"))
    joined = marked.join(offsets if within else F.broadcast(offsets), [*within, "__part"])
    return joined.withColumn("place", F.col("__offset") + F.col("__at") + 1).select(*rows.columns, "place")


def letter_pages(names: DataFrame, per_page: int) -> DataFrame:
    """(letter, page): the first page on which a letter stands in the order of names."""
    placed = with_places(names.select("name", "id"), ["name", "id"])
    return placed.groupBy(index_letter(F.col("name")).alias("letter")).agg((F.floor((F.min("place") - 1) / per_page) + 1).cast("long").alias("page"))


def runs_of(rows: DataFrame, order) -> DataFrame:
    """(scope, run, letter, n, occurrence): consecutive rows of one letter in the window `order`, which run of its letter each is.

    rows: scope, letter and the columns of the order. A scope is the unit of one window task.
    """
    step = F.coalesce((F.col("letter") != F.lag("letter").over(order)).cast("int"), F.lit(1))
    stepped = rows.withColumn("step", step)
    runs = stepped.withColumn("run", F.sum("step").over(order)).groupBy("scope", "run", "letter").agg(F.count(F.lit(1)).alias("n"))
    return runs.withColumn("occurrence", F.row_number().over(Window.partitionBy("scope", "letter").orderBy("run")))


def keyset(rows: DataFrame, key: str, after: int = 0, limit: int = 50) -> DataFrame:
    """The rows after a key, in key order: the filter reaches the scan, and no offset is counted."""
    if after < 0 or not 1 <= limit <= 200:
        raise ValueError("after must be 0 or more, limit 1 to 200")
    return rows.filter(F.col(key) > after).orderBy(key).limit(limit)


def counts_without_fan_out(base: DataFrame, key: str, sides: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Distinct counts over several independent 1:N tables; each is aggregated before it is joined."""
    for name, (side, value) in sides.items():
        counted = side.groupBy(key).agg(F.countDistinct(value).alias(name))
        base = base.join(counted, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return base


def photos_with_all(links: DataFrame, persons: list[int]) -> DataFrame:
    """(item_id, photo_id): an item's earliest photo (position, id) that shows all the persons: relational division."""
    wanted = list(dict.fromkeys(persons))
    shown = [F.bool_or(F.col("person_id") == p).alias(f"__{k}") for k, p in enumerate(wanted)]  # one flag a person: no set is held
    seen = links.filter(F.col("person_id").isin(*wanted)).groupBy("item_id", "photo_id", "position").agg(*shown)
    full = seen.filter(" AND ".join(f"__{k}" for k in range(len(wanted))))
    return full.groupBy("item_id").agg(F.min(F.struct("position", "photo_id")).alias("x")).select("item_id", "x.photo_id")
