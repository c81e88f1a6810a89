"""Row-level security and renderability, applied before any match, count or rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What each role may see; an unknown role sees what is public.
ALLOWED = {"public": ("PUBLIC",), "family": ("PUBLIC", "PRIVATE"), "admin": ("PUBLIC", "PRIVATE", "RESTRICTED")}


def can_view(visibility: Column, role: str, permitted: Column | None = None) -> Column:
    """Unknown and null visibilities fail closed; RESTRICTED may be permitted explicitly."""
    seen = F.coalesce(visibility.isin(*ALLOWED.get(role, ALLOWED["public"])), F.lit(False))
    return seen if permitted is None else seen | ((visibility == "RESTRICTED") & F.coalesce(permitted, F.lit(False)))


def visible(items: DataFrame, role: str = "public") -> DataFrame:
    return items.filter(can_view(F.col("visibility"), role))


def renderable(items: DataFrame, photos: DataFrame) -> DataFrame:
    """Photos need a first photo (position, id) with a key, documents an upload; other types pass.

    photos: item_id, photo_id, position, status, key. An outer join on the one chosen photo per item.
    """
    first = photos.groupBy("item_id").agg(F.min(F.struct("position", "photo_id", "status", "key")).alias("first"))
    good = first.filter((F.col("first.status") == "UPLOADED") & (F.length(F.trim("first.key")) > 0)).select(F.col("item_id").alias("__photo"))
    joined = items.join(good, F.col("item_id") == F.col("__photo"), "left")
    rule = F.when(F.col("item_type") == "PHOTO", F.col("__photo").isNotNull()).when(F.col("item_type") == "DOCUMENT", F.col("upload_status") == "UPLOADED").otherwise(True)
    return joined.filter(rule).drop("__photo")


def uploaded_for(items: DataFrame, role: str) -> DataFrame:
    """Visible documents; all but the admin need a finished upload."""
    rows = visible(items, role)
    return rows if role == "admin" else rows.filter(F.col("upload_status") == "UPLOADED")


def member_or_named(items: DataFrame, links: DataFrame, names: DataFrame) -> DataFrame:
    """(item, author): linked; or, where an item has no link at all, named so, if one author only has the name.

    links: item_id, author_id. names: author_id, name. items: item_id, author.
    """
    direct = items.join(links, "item_id").select("item_id", "author_id")
    unique = names.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("author_id").alias("author_id")).filter("n = 1")
    legacy = items.join(links, "item_id", "left_anti").join(unique, F.col("author") == F.col("name")).select("item_id", "author_id")
    return direct.unionByName(legacy).distinct()
