"""Persons and authors as searches and directories see them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def has_text(value: Column) -> Column:
    """A value with anything but blanks in it."""
    return F.coalesce(value.rlike("\\S"), F.lit(False))


def named(persons: DataFrame, aliases: DataFrame, families: DataFrame, needle: str) -> DataFrame:
    """(person_id): name, an alias or a family name contains the needle, case ignored. All three: person_id, name. A union of arms, as a person of many aliases counts once."""
    inside = F.contains(F.lower("name"), F.lit(needle.strip().lower()))
    arms = [side.filter(inside).select("person_id") for side in (persons, aliases, families)]
    return arms[0].unionByName(arms[1]).unionByName(arms[2]).distinct()


def authored(links: DataFrame, authors: DataFrame, items: DataFrame) -> DataFrame:
    """(person_id, item_id) of the items that a person's author identities have written, items (item_id) being those that may be seen.

    links: item_id, author_id. authors: author_id, person_id, which may be null.
    """
    known = authors.filter("person_id IS NOT NULL").select("author_id", "person_id")
    return links.join(items.select("item_id"), "item_id", "left_semi").join(known, "author_id").select("person_id", "item_id").distinct()


def public_authors(authors: DataFrame, links: DataFrame, items: DataFrame) -> DataFrame:
    """Authors with an item that may be seen."""
    seen = links.join(items.select("item_id"), "item_id", "left_semi").select("author_id")
    return authors.join(seen, "author_id", "left_semi")


def public_persons(persons: DataFrame, *memberships: DataFrame) -> DataFrame:
    """Persons with a biography, or with a membership (person_id) of any kind."""
    members = memberships[0].select("person_id")
    for more in memberships[1:]:
        members = members.unionByName(more.select("person_id"))
    flagged = persons.join(members.distinct().withColumn("__member", F.lit(True)), "person_id", "left")
    return flagged.filter(F.col("__member").isNotNull() | has_text(F.col("biography"))).select(*persons.columns)


def items_of_persons(direct: DataFrame, pictured: DataFrame, written: DataFrame) -> DataFrame:
    """(person_id, item_id, ways, photo_id): items that a person is linked to, pictured in or the author of; ways: how many of these hold; photo_id: the first photo of the item that shows them.

    direct, written: person_id, item_id. pictured: person_id, item_id, position, photo_id. Keys are united first, so that no way multiplies another.
    """
    photo = pictured.groupBy("person_id", "item_id").agg(F.min(F.struct("position", "photo_id")).alias("first"))
    keys = [side.select("person_id", "item_id").distinct() for side in (direct, photo, written)]
    united = keys[0].unionByName(keys[1]).unionByName(keys[2]).groupBy("person_id", "item_id").agg(F.count(F.lit(1)).alias("ways"))
    return united.join(photo, ["person_id", "item_id"], "left").select("person_id", "item_id", "ways", F.col("first.photo_id").alias("photo_id"))


def further_names(persons: DataFrame, aliases: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """(person_id, kind, names): public aliases by kind in the order of `kinds`, unknown ones last under `other`.

    persons: person_id, name. aliases: alias_id, person_id, name, kind, is_public. Blank names and the
    person's own are left out; of names that differ in case only the first by id stays.
    """
    shown = aliases.filter(F.col("is_public") & has_text(F.col("name"))).withColumn("key", F.lower(F.trim("name")))
    own = persons.select("person_id", F.lower(F.trim("name")).alias("key"))
    once = shown.join(own, ["person_id", "key"], "left_anti").groupBy("person_id", "key").agg(F.min(F.struct("alias_id", F.trim("name").alias("name"), "kind")).alias("x"))
    kind = F.when(F.col("x.kind").isin(*kinds), F.col("x.kind")).otherwise("other")
    return once.groupBy("person_id", kind.alias("kind")).agg(F.array_join(F.array_sort(F.collect_list("x.name")), ", ").alias("names"))


def photo_fields(photos: DataFrame, shown: DataFrame) -> DataFrame:
    """(item_id, segments): the texts of an item's photos by (position, photo_id), then the names of who they show, in lines; blanks collapsed, repeats dropped.

    photos: item_id, photo_id, position, texts (array). shown: photo_id, name.
    """
    texts = photos.groupBy("item_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("position", "photo_id", "texts"))), lambda p: p["texts"])).alias("texts"))
    names = photos.join(shown, "photo_id").groupBy("item_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    both = F.concat("texts", F.coalesce("names", F.array().cast("array<string>")))
    clean = F.filter(F.transform(both, lambda x: F.trim(F.regexp_replace(x, "\\s+", " "))), lambda x: x != "")
    return texts.join(names, "item_id", "left").select("item_id", F.array_join(F.array_distinct(clean), "\n").alias("segments"))


def outliers(members: DataFrame, flags: tuple[str, ...], most: int = 3) -> DataFrame:
    """(group, member, place): up to `most` members of each group with a risk that not all of the group have, by the order of risks, then of members.

    members: group, member and a boolean for each of the flags. Groups of one have none.
    """
    whole = Window.partitionBy("group")
    first = F.lit(None).cast("int")
    for k, flag in reversed(list(enumerate(flags))):
        n = F.count_if(F.col(flag)).over(whole)
        first = F.when(F.col(flag) & (n < F.count(F.lit(1)).over(whole)), k).otherwise(first)
    odd = members.withColumn("__risk", first).filter("__risk IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("group").orderBy("__risk", "member"))
    return odd.withColumn("place", place).filter(F.col("place") <= most).select("group", "member", "place")
