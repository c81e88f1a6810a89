"""Dictionary entities in texts: ranked lookup, detection, containment, validity, grouped review."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import DASHES, bound, fold_dashes, json_hash

MAX_SURFACE = 255
#: Surfaces that are broadcast, of 255 characters at most; and the size of the table of first words.
BROADCAST_SURFACES = 100_000
FIRST_WORD_BINS = 4096
#: Characters of texts whose hits one task takes where hits are dealt by item or key.
SHARE_CHARS = 8_000_000
# Bidirectional marks that a surface loses.
BIDI = "‎‏‪‫‬‭‮⁦⁧⁨⁩"


def normal_surface(name):
    return F.trim(F.regexp_replace(F.lower(F.translate(name, BIDI, "")), "\\s+", " "))


def folded_query(query: str) -> str:
    """A query as names are compared with it: trimmed, the same dashes folded, in lower case."""
    return query.strip().translate({ord(c): "-" for c in DASHES}).lower()


def matched_aliases(aliases: DataFrame, query: str, hidden: str = "OCR_VARIANT") -> DataFrame:
    """(entity_id, alias): of the aliases (alias_id, entity_id, alias, kind) in which a query stands that of the best rank, then by name, then by id.

    Exact, prefix, within. Aliases of the kind `hidden` find their entity, but are never shown.
    """
    q, low = F.lit(folded_query(query)), F.lower(fold_dashes(F.col("alias")))
    rank = F.when(low == q, 3).when(F.startswith(low, q), 5).when(F.contains(low, q), 7)
    rows = aliases.filter(~F.col("kind").eqNullSafe(hidden)).withColumn("__rank", rank).filter("__rank IS NOT NULL")
    best = F.min(F.struct("__rank", low.alias("low"), "alias_id", fold_dashes(F.col("alias")).alias("alias")))
    return rows.groupBy("entity_id").agg(best.alias("x")).select("entity_id", "x.alias")


def registry_rank(entities: DataFrame, aliases: DataFrame, query: str) -> DataFrame:
    """(entity_id, rank), 1 to 7: exact display, canonical, alias; prefix of name, alias; within name, alias.

    entities: entity_id, display, canonical. aliases: entity_id, alias.
    """
    q = folded_query(query)
    low = lambda c: F.lower(fold_dashes(F.col(c)))
    name = F.least(
        F.when(low("display") == q, 1), F.when(low("canonical") == q, 2),
        F.when(F.startswith(low("display"), F.lit(q)) | F.startswith(low("canonical"), F.lit(q)), 4),
        F.when(F.contains(low("display"), F.lit(q)) | F.contains(low("canonical"), F.lit(q)), 6),
    )
    alias = F.when(low("alias") == q, 3).when(F.startswith(low("alias"), F.lit(q)), 5).when(F.contains(low("alias"), F.lit(q)), 7)
    ranks = entities.select("entity_id", name.alias("rank")).unionByName(aliases.select("entity_id", alias.alias("rank")))
    return ranks.filter("rank IS NOT NULL").groupBy("entity_id").agg(F.min("rank").alias("rank"))


def detect(texts: DataFrame, surfaces: DataFrame, max_words: int = 8) -> DataFrame:
    """Hits (item_id, surface, start, end, in words) of dictionary surfaces that stand between word bounds.

    texts: item_id, text. surfaces: surface (normal form, words apart by one space). Of a text's words those
    stay that may begin a surface, by a table of hashes of first words; only there n-grams are made, and
    they meet the dictionary in an equi join: no text is compared with every surface. A dictionary of up to
    BROADCAST_SURFACES is broadcast, so that a frequent surface is no hot key; a larger one is joined by
    shuffle, its frequent surfaces' rows being split at run time. Surfaces of more words than `max_words` are refused.
    """
    dictionary = surfaces.select("surface", F.split("surface", " ").alias("w")).filter(F.length("surface").between(1, MAX_SURFACE)).distinct()
    facts = dictionary.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.size("w")).alias("lengths"), F.collect_set(_bin(F.get("w", F.lit(0)))).alias("bins")).first()
    lengths = sorted(facts["lengths"])
    if lengths and lengths[-1] > max_words:
        raise ValueError(f"a surface has more than {max_words} words")
    if not lengths:
        return texts.select("item_id", F.lit("").alias("surface"), F.lit(0).alias("start"), F.lit(0).alias("end")).filter(F.lit(False))
    begins = F.array(*[F.lit(k in set(facts["bins"])) for k in range(FIRST_WORD_BINS)])

    def grams(w):
        """The n-grams of a text's words that may be surfaces, with their places."""
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(begins, _bin(F.get(w, i))))
        made = F.transform(at, lambda i: F.array(*[F.struct(F.array_join(F.slice(w, i + 1, n), " ").alias("surface"), i.alias("start"), (i + n).alias("end")) for n in lengths]))
        return F.filter(F.flatten(made), lambda x: x["end"] <= F.size(w))

    words = texts.select("item_id", F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}\\p{M}]+"), lambda w: w != "").alias("words")).filter(F.size("words") > 0)
    # the n-grams of a text are one array before they become rows, so that no row carries the whole text
    rows = words.select("item_id", F.explode(bound(F.col("words"), grams)).alias("x")).select("item_id", "x.*")
    known = dictionary.select("surface")
    return rows.join(F.broadcast(known) if facts["n"] <= BROADCAST_SURFACES else known, "surface").select("item_id", "surface", "start", "end")


def _bin(word):
    return F.pmod(F.xxhash64(word), F.lit(FIRST_WORD_BINS)).cast("int")


def shares(texts: DataFrame) -> int:
    """Partitions for the hits of texts (item_id, text), a number that grows with their characters, so that a task's share of hits does not. Reads the texts once."""
    return 1 + (texts.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0) // SHARE_CHARS


def surviving(hits: DataFrame, parts: int | None = None) -> DataFrame:
    """Hits that no hit of another surface strictly contains.

    Within an item a longer hit that covers a position is the one that reaches farthest among those that
    start no later: running maxima replace the pairwise comparison. Items are dealt to `parts` partitions; None: as the session has it.
    """
    hits = hits.repartition(parts, "item_id") if parts else hits
    up_to = Window.partitionBy("item_id").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("item_id", "start")
    reach = hits.withColumn("__before", F.max("end").over(up_to)).withColumn("__here", F.max("end").over(same))
    inside = (F.coalesce(F.col("__before") >= F.col("end"), F.lit(False))) | (F.col("__here") > F.col("end"))
    return reach.filter(~inside).drop("__before", "__here")


def valid_occurrences(occurrences: DataFrame, texts: DataFrame) -> DataFrame:
    """Occurrences whose pinned SHA-256 is that of the item's text of today. occurrences: item_id, sha, …; texts: item_id, text."""
    now = texts.select("item_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return occurrences.join(now, ["item_id", "sha"], "left_semi")


def grouped(hits: DataFrame, many: int = 5, short: int = 3) -> DataFrame:
    """(surface, group_id, items, hits, many_items, short_surface, first_item): review groups of hits."""
    rows = hits.groupBy("surface").agg(F.countDistinct("item_id").alias("items"), F.count(F.lit(1)).alias("hits"), F.min("item_id").alias("first_item"))
    return rows.withColumn("group_id", json_hash(F.col("surface"))).withColumn("many_items", F.col("items") >= many).withColumn("short_surface", F.length("surface") <= short)


def review_groups(candidates: DataFrame, reasons: DataFrame, many: int = 5, short: int = 3) -> DataFrame:
    """(group_id, entity_id, surface, text_kind, reasons, members, items, short_surface, many_items, several_reasons): candidates that are reviewed together.

    candidates: candidate_id, entity_id, surface, text_kind, item_id. reasons: candidate_id, method, alias_kind.
    Candidates of one entity, surface and kind of text are together if the same set of reasons holds for them.
    """
    reason = F.concat_ws("/", "method", F.coalesce("alias_kind", F.lit("")))
    sets = reasons.groupBy("candidate_id").agg(F.array_join(F.array_sort(F.collect_set(reason)), ",").alias("reasons"))
    per = candidates.join(sets, "candidate_id", "left").withColumn("reasons", F.coalesce("reasons", F.lit("")))
    key = ["entity_id", "surface", "text_kind", "reasons"]
    rows = per.groupBy(*key).agg(F.count(F.lit(1)).alias("members"), F.countDistinct("item_id").alias("items"))
    return rows.select(
        json_hash(*key).alias("group_id"), *key, "members", "items", (F.length("surface") <= short).alias("short_surface"), (F.col("items") >= many).alias("many_items"),
        F.contains("reasons", F.lit(",")).alias("several_reasons"),
    )


def cover_of(hits: DataFrame, max_words: int = 8) -> DataFrame:
    """(item_id, surface, start, end, cover) of contained hits: the longest cover, then the earliest, then by surface.

    A cover has `max_words` words at most, and so begins at most so many words before: the hits of those
    places are all that a hit is compared with.
    """
    near = Window.partitionBy("item_id").orderBy("start").rangeBetween(1 - max_words, 0)
    rows = hits.withColumn("__near", F.collect_set(F.struct((F.col("start") - F.col("end")).alias("minus"), "start", "end", "surface")).over(near))
    covers = F.filter("__near", lambda x: (x["end"] >= F.col("end")) & (x["minus"] < F.col("start") - F.col("end")))
    return rows.select("item_id", "surface", "start", "end", F.array_min(covers)["surface"].alias("cover")).filter("cover IS NOT NULL").distinct()


def excluded(items: DataFrame, low: int | None = None, high: int | None = None, after: int | None = None) -> DataFrame:
    """(photos, videos, without_text): items within the bounds of ids that a run does not look at, in one pass. items: item_id, item_type, text."""
    k = F.col("item_id")
    for bound_, condition in ((low, lambda v: k >= v), (high, lambda v: k <= v), (after, lambda v: k > v)):
        items = items if bound_ is None else items.filter(condition(bound_))
    kind = F.col("item_type")
    return items.agg(
        F.count_if(kind == "PHOTO").alias("photos"), F.count_if(kind == "VIDEO").alias("videos"), F.count_if(kind.isin("DOCUMENT", "TEXT") & F.col("text").isNull()).alias("without_text")
    )


def checked(items: DataFrame, sha: str = "sha") -> DataFrame:
    """`items` (item_id, text, sha) with `failure`: what keeps one from being examined, so that it does not stop the others; null where nothing does."""
    failure = F.when(F.col("text").isNull(), "missing_text").when(~F.col(sha).eqNullSafe(F.sha2("text", 256)), "stale_text")
    return items.withColumn("failure", failure)


def run_report(examined: DataFrame) -> DataFrame:
    """(examined, failures, cursor) of a run over items (item_id, failure): the cursor is the last id before the first failure, from which a later run may go on."""
    first = examined.agg(F.min(F.when(F.col("failure").isNotNull(), F.col("item_id"))).alias("__first"))
    rows = examined.crossJoin(F.broadcast(first))  # one row
    return rows.agg(
        F.count(F.lit(1)).alias("examined"), F.count("failure").alias("failures"),
        F.max(F.when(F.col("__first").isNull() | (F.col("item_id") < F.col("__first")), F.col("item_id"))).alias("cursor"),
    )


def ledger(found: DataFrame, stored: DataFrame, keys: list[str], parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows to append, (new, existing)): each found key once; those that the ledger holds are counted, whatever their status, and never written again.

    Both sides are dealt by all keys to `parts` partitions, in which they are made distinct and meet; None: as the session has it.
    """
    dealt = lambda df: df.repartition(parts, *keys) if parts else df
    once = dealt(found).dropDuplicates(keys)
    known = dealt(stored.select(*keys)).distinct().withColumn("__known", F.lit(True))
    flagged = once.join(known, keys, "left")
    counts = flagged.agg(F.count_if(F.col("__known").isNull()).alias("new"), F.count("__known").alias("existing"))
    return flagged.filter("__known IS NULL").select(*found.columns), counts


def without_retired(entities: DataFrame, retired: DataFrame) -> DataFrame:
    return entities.join(retired.select("entity_id"), "entity_id", "left_anti")


def examine(items: DataFrame, surfaces: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows to append, counts of new and existing, report) of a run over items (item_id, text, sha); nothing is written: a dry run stops here, an applied one appends the rows.

    stored: item_id, surface, start. Items that fail are left out and counted, the others go on.
    """
    examined, parts = checked(items), shares(items)
    found = surviving(detect(examined.filter("failure IS NULL").select("item_id", "text"), surfaces), parts)
    rows, counts = ledger(found, stored, ["item_id", "surface", "start"], parts)
    return rows, counts, run_report(examined)
