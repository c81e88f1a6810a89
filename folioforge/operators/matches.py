"""Where the terms of a query stand in texts: hits, snippets, segments, literal ranges and their boxes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters that a snippet aims at, and that the matches of one window span at most.
TARGET, CAP = 190, 220
WORD = "[\\p{L}\\p{N}]"


def _parted(texts: DataFrame, keys: list[str], pattern: Column | str) -> DataFrame:
    """(keys, start, end, hit) of a pattern's matches in `text`: each match's place follows from the lengths of all pieces before."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    pieces = F.arrays_zip(F.split("text", pattern, -1).alias("gap"), F.regexp_extract_all("text", pattern, F.lit(0)).alias("hit"))
    rows = texts.select(*keys, F.posexplode(pieces).alias("k", "x")).select(*keys, "k", "x.*").filter("hit IS NOT NULL")
    up_to = Window.partitionBy(*keys).orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.length("gap") + F.length("hit")).over(up_to)
    return rows.withColumn("end", end).select(*keys, (F.col("end") - F.length("hit")).alias("start"), "end", "hit")


def token_spans(texts: DataFrame) -> DataFrame:
    """(item_id, start, end, token): the runs of letters and digits of texts (item_id, text), in the text's own case, and their places."""
    return _parted(texts, ["item_id"], f"{WORD}+").select("item_id", "start", "end", F.col("hit").alias("token"))


def hits(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """(item_id, start, end, term) of the wanted words, case ignored, in texts (item_id, text)."""
    words = "|".join(map(re.escape, wanted)) or "(?!)"
    found = _parted(texts, ["item_id"], f"(?iu)(?<!{WORD})(?:{words})(?!{WORD})")
    return found.select("item_id", "start", "end", F.lower("hit").alias("term"))


def best_windows(found: DataFrame) -> DataFrame:
    """(item_id, n_terms, low, high): of the windows of CAP characters at most that begin with a hit, that of the most distinct terms, the earliest."""
    ahead = Window.partitionBy("item_id").orderBy("start").rangeBetween(0, CAP)
    rows = found.withColumn("ahead", F.collect_list(F.struct("end", "term")).over(ahead))
    within = F.filter("ahead", lambda x: x["end"] <= F.greatest(F.col("start") + CAP, F.col("end")))
    rows = rows.withColumn("within", within).select(
        "item_id", F.struct((-F.size(F.array_distinct("within.term"))).alias("minus"), F.col("start").alias("low"), F.array_max("within.end").alias("high")).alias("x")
    )
    return rows.groupBy("item_id").agg(F.min("x").alias("x")).select("item_id", (-F.col("x.minus")).cast("long").alias("n_terms"), "x.low", "x.high")


def snippets(texts: DataFrame, wanted: list[str]) -> DataFrame:
    """(item_id, snippet, n_terms) of texts (item_id, text): the best window, filled up to TARGET on both sides, ends moved outward to whole words.

    What one side does not need goes to the other; an ellipsis stands where the text is cut. Blanks are
    collapsed. A text without a hit shows its beginning.
    """
    plain = texts.select("item_id", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\\s+", " ")).alias("text"))
    rows = plain.join(best_windows(hits(plain, wanted)), "item_id", "left")
    c, size = F.col, F.length("text")
    spare = F.greatest(F.lit(0), TARGET - (c("high") - c("low")))
    rows = rows.withColumn("spare", spare).withColumn("right", F.least(size - c("high"), c("spare") - F.least(c("low"), F.floor(c("spare") / 2))))
    rows = rows.withColumn("low", c("low") - F.least(c("low"), c("spare") - c("right"))).withColumn("high", c("high") + c("right"))
    before, after, head, tail = F.left("text", c("low")), F.substr("text", c("low") + 1), F.left("text", c("high")), F.substr("text", c("high") + 1)
    back = F.when(after.rlike(f"^{WORD}"), F.length(F.regexp_extract(before, f"{WORD}+$", 0))).otherwise(0)
    on = F.when(head.rlike(f"{WORD}$"), F.length(F.regexp_extract(tail, f"^{WORD}+", 0))).otherwise(0)
    rows = rows.withColumn("low", F.coalesce(c("low") - back, F.lit(0))).withColumn("high", F.coalesce(c("high") + on, F.least(size, F.lit(TARGET))))
    dots = lambda where: F.when(where, F.lit("…")).otherwise(F.lit(""))
    shown = F.concat(dots(c("low") > 0), F.substr("text", c("low") + 1, c("high") - c("low")), dots(c("high") < size))
    return rows.select("item_id", shown.alias("snippet"), F.coalesce("n_terms", F.lit(0).cast("long")).alias("n_terms"))


def segments(shown: DataFrame, wanted: list[str]) -> DataFrame:
    """(item_id, place, part, is_match): snippets (item_id, snippet) in parts, matched words apart from what is between them."""
    words = "|".join(map(re.escape, wanted)) or "(?!)"
    pattern = f"(?iu)(?<!{WORD})(?:{words})(?!{WORD})"
    pieces = F.arrays_zip(F.split("snippet", pattern, -1).alias("gap"), F.regexp_extract_all("snippet", F.lit(pattern), F.lit(0)).alias("hit"))
    pair = lambda x: F.array(F.struct(x["gap"].alias("part"), F.lit(False).alias("is_match")), F.struct(x["hit"].alias("part"), F.lit(True).alias("is_match")))
    parts = F.filter(F.flatten(F.transform(pieces, pair)), lambda x: F.length(x["part"]) > 0)
    return shown.select("item_id", F.posexplode(parts).alias("place", "x")).select("item_id", "place", "x.part", "x.is_match")


def presentation(body: DataFrame, translation: DataFrame, labels: DataFrame, wanted: list[str]) -> DataFrame:
    """(item_id, shown, n_terms): which text an item shows: the one whose best window has more distinct terms, the body on a tie.

    body, translation: item_id, text. labels: item_id, label, the metadata field that matched, `several` or
    `none`; it is shown where neither text has a hit, and `title` and `none` show nothing.
    """
    best = lambda texts, name: best_windows(hits(texts, wanted)).select("item_id", F.col("n_terms").alias(name))
    rows = labels.join(best(body, "b"), "item_id", "left").join(best(translation, "t"), "item_id", "left")
    b, t = F.coalesce("b", F.lit(0)), F.coalesce("t", F.lit(0))
    shown = F.when((b > 0) & (b >= t), "body").when(t > 0, "translation").when(~F.col("label").isin("none", "title"), F.concat(F.lit("metadata:"), F.col("label")))
    return rows.select("item_id", shown.alias("shown"), F.greatest(b, t).cast("long").alias("n_terms"))


def literal_ranges(texts: DataFrame, keys: list[str], literals: list[str]) -> DataFrame:
    """(keys, term, start, end): non-overlapping places of each literal, case ignored. A text whose lower case has another length has none, as places would not fit it."""
    kept = texts.filter(F.length(F.lower("text")) == F.length("text"))
    quoted = [(t, f"(?iu){re.escape(t)}") for t in dict.fromkeys(x.lower() for x in literals) if t]
    made = [_parted(kept, keys, p).select(*keys, F.lit(t).alias("term"), "start", "end") for t, p in quoted]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def overlay(geometry: DataFrame, pages: DataFrame) -> DataFrame:
    """(match, page, position, left, top, width, height) in percent of the page; a match with any line of no page size or beyond its page is dropped whole.

    geometry: match, page, position, x0, y0, x1, y1. pages: page, page_width, page_height.
    """
    rows = geometry.join(pages, "page", "left")
    c = F.col
    good = F.coalesce((c("page_width") > 0) & (c("page_height") > 0) & (c("x0") >= 0) & (c("y0") >= 0) & (c("x1") > c("x0")) & (c("y1") > c("y0")) & (c("x1") <= c("page_width")) & (c("y1") <= c("page_height")), F.lit(False))
    bad = rows.filter(~good).select("match").distinct()
    share = lambda a, b: F.round(F.lit(100.0) * a / b, 6)
    return rows.join(bad, "match", "left_anti").select(
        "match", "page", "position", share(c("x0"), c("page_width")).alias("left"), share(c("y0"), c("page_height")).alias("top"),
        share(c("x1") - c("x0"), c("page_width")).alias("width"), share(c("y1") - c("y0"), c("page_height")).alias("height"),
    )
