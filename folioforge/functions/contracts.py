"""Validation of payloads, addresses and hash trees as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of MIME types that uploads carry.
MIME_ALIASES = {"image/jpg": "image/jpeg", "image/pjpeg": "image/jpeg", "image/x-png": "image/png", "application/x-pdf": "application/pdf"}
PAGES = "array<struct<page_index:int,text:string>>"


def mime_type(raw: Column) -> Column:
    """Lower case, parameters dropped, aliases resolved; null for a blank."""
    clean = F.trim(F.lower(F.split(raw, ";")[0]))
    known = F.create_map(*[x for pair in MIME_ALIASES.items() for x in map(F.lit, pair)])
    return F.when(clean != "", F.coalesce(F.try_element_at(known, clean), clean))


def video_address(raw: Column) -> Column:
    """(provider, video_id, start) of a video address; null for anything else."""
    address = F.trim(raw)
    tube = F.regexp_extract(address, "(?:youtube\\.com/(?:watch\\?(?:.*&)?v=|embed/|shorts/)|youtu\\.be/)([A-Za-z0-9_-]{11})", 1)
    vimeo = F.regexp_extract(address, "vimeo\\.com/(?:video/)?(\\d+)", 1)
    start = F.regexp_extract(address, "[?&#](?:t|start)=(\\d+)", 1)
    seconds = F.when(start != "", start.cast("long"))
    return F.when(tube != "", F.struct(F.lit("youtube").alias("provider"), tube.alias("video_id"), seconds.alias("start"))).when(
        vimeo != "", F.struct(F.lit("vimeo").alias("provider"), vimeo.alias("video_id"), seconds.alias("start"))
    )


def display_name(name: Column, honorific: Column) -> Column:
    return F.concat_ws(" ", F.when(F.trim(honorific) != "", F.trim(honorific)), F.trim(name))


def payload_error(raw: Column, expected_pages: Column, version: int = 1) -> Column:
    """First thing wrong with a transcription payload: json, keys, version, page_count, page_order, no_text; null if nothing is."""
    body = F.from_json(raw, f"schema_version int, pages {PAGES}")
    keys = F.json_object_keys(raw)
    pages = body["pages"]
    order = F.transform(pages, lambda p: p["page_index"])
    return (
        F.when(keys.isNull() | body.isNull(), "json")
        .when(F.array_sort(keys) != F.array(F.lit("pages"), F.lit("schema_version")), "keys")
        .when(~body["schema_version"].eqNullSafe(F.lit(version)), "version")
        .when(pages.isNull() | (F.size(pages) != expected_pages), "page_count")
        .when(order != F.sequence(F.lit(1), F.greatest(F.lit(1), expected_pages)), "page_order")
        .when(~F.exists(pages, lambda p: F.coalesce(p["text"].rlike("\\S"), F.lit(False))), "no_text")
    )


def page_numbers(raw: Column) -> Column:
    """A JSON object index -> number as a map from 1-based indexes; keys 0..n-1 are shifted, 1..n are kept, all else and repeated numbers are null."""
    entries = F.map_entries(F.from_json(raw, "map<string,int>"))
    keys = F.array_sort(F.transform(entries, lambda e: F.when(e["key"].rlike("^\\d{1,9}$"), e["key"]).cast("int")))
    values = F.transform(entries, lambda e: e["value"])
    n = F.size(entries)
    low = F.array_min(keys)
    dense = (keys == F.sequence(low, low + n - 1)) & low.isin(0, 1)
    unique = F.size(F.array_distinct(values)) == n
    shifted = F.map_from_entries(F.transform(entries, lambda e: F.struct((e["key"].cast("int") + 1 - low).alias("key"), e["value"].alias("value"))))
    return F.when((n > 0) & F.forall(keys, lambda k: k.isNotNull()) & dense & unique & F.forall(values, lambda v: v.isNotNull()), shifted)


def fingerprint(ordered_hashes: Column) -> Column:
    """SHA-256 over hashes in order."""
    return F.sha2(F.array_join(ordered_hashes, "\n"), 256)


def attempt_identity(pages: Column, source: Column, route: Column) -> Column:
    """Hash tree of an attempt: pages, then source, then route."""
    return F.sha2(F.concat_ws("|", fingerprint(pages), F.sha2(source, 256), F.sha2(route, 256)), 256)


def word_boxes(raw: Column, width: Column, height: Column) -> Column:
    """Words of a one-page vision payload as (index, text, x0, y0, x1, y1); null if a node is malformed or a box lies beyond the page."""
    vertex = "array<struct<x:int,y:int>>"
    body = F.from_json(
        raw, f"pages array<struct<blocks:array<struct<paragraphs:array<struct<words:array<struct<boundingBox:struct<vertices:{vertex}>,symbols:array<struct<text:string>>>>>>>>>>"
    )
    paragraphs = F.flatten(F.transform(body["pages"][0]["blocks"], lambda b: b["paragraphs"]))
    words = F.flatten(F.transform(paragraphs, lambda p: p["words"]))
    xs = lambda w: F.transform(w["boundingBox"]["vertices"], lambda v: v["x"])
    ys = lambda w: F.transform(w["boundingBox"]["vertices"], lambda v: v["y"])
    flat = F.transform(
        words,
        lambda w, i: F.struct(
            i.alias("index"), F.array_join(F.transform(w["symbols"], lambda s: s["text"]), "").alias("text"), F.array_min(xs(w)).alias("x0"), F.array_min(ys(w)).alias("y0"),
            F.array_max(xs(w)).alias("x1"), F.array_max(ys(w)).alias("y1"), (F.size(w["boundingBox"]["vertices"]) == 4).alias("whole"),
        ),
    )
    good = F.forall(flat, lambda w: F.coalesce(w["whole"] & (w["x0"] >= 0) & (w["y0"] >= 0) & (w["x1"] <= width) & (w["y1"] <= height) & (w["text"] != ""), F.lit(False)))
    shown = F.transform(flat, lambda w: F.struct(*[w[c].alias(c) for c in ("index", "text", "x0", "y0", "x1", "y1")]))
    return F.when((F.size(body["pages"]) == 1) & good, shown)
