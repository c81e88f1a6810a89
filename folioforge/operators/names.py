"""The names of a registry behind grams: a ranked lookup that reads what may match instead of all names.

Every different folded name is posted under its runs of one, two and three characters. A query's rarest runs are
intersected, the names left are read and compared with the query itself, so that a lookup equals a scan of
all names: postings only say where to look. Postings lie in the order of their grams, and names in folders by
their key, so that both reads are of few files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import fold_dashes, folded, sort_key
from folioforge.operators.directory import with_places
from folioforge.operators.entities import folded_query
from folioforge.sources.shared import cut

LONGEST_GRAM = 3
#: Of a query's grams so many, the rarest ones, are intersected.
PROBES = 4
#: Names are parted into so many folders; candidates of at most so many names are broadcast.
BUCKETS, BROADCAST_KEYS = 64, 200_000
NAMES = "key long, low string, source int, entity_id long, alias_id long, shown string, hidden boolean, public string, entity_type string, bucket int"
ENTITIES = "entity_id long, public string, entity_type string, script int, sort string"
POSTINGS = "gram string, key long"
COUNTS = "gram string, n long"
DISPLAY, CANONICAL, ALIAS = 1, 2, 3
RANKED = "entity_id long, rank int, public string, matched_alias string"


def grams_of(low: Column, size: int) -> Column:
    """The runs of `size` characters of a text; none where it is shorter."""
    starts = F.sequence(F.lit(1), F.length(low) - size + 1)
    return F.when(F.length(low) >= size, F.transform(starts, lambda i: F.substring(low, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def lowered(name: Column) -> Column:
    return F.lower(fold_dashes(name))


def public_name(display: Column, canonical: Column) -> Column:
    """What readers see: the display name, the canonical one where that is blank; long dashes folded."""
    return fold_dashes(F.coalesce(F.when(F.trim(display) != "", display), canonical))


class Registry:
    """An index of names in a folder that all executors share; `build` writes it, lookups read it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{part}")

    def build(self, entities: DataFrame, aliases: DataFrame, retired: DataFrame | None = None, hidden: str = "OCR_VARIANT") -> Registry:
        """entities: entity_id, display, canonical, entity_type. aliases: alias_id, entity_id, alias, kind. retired: entity_id.

        Retired entities and the aliases of no entity are left out, null names are none, an entity without a
        name is found by a blank query alone. Aliases of the kind `hidden` are found, but never shown.
        Repeated rows change nothing. Extra columns are not read.
        """
        kept = entities if retired is None else entities.join(retired.select("entity_id"), "entity_id", "left_anti")
        kept = kept.select("entity_id", "display", "canonical", public_name(F.col("display"), F.col("canonical")).alias("public"), "entity_type")
        none, no = F.lit(None).cast("long"), F.lit(False)
        fields = lambda source, name, alias_id, is_hidden: F.struct(F.lit(source).alias("source"), name.alias("name"), alias_id.alias("alias_id"), is_hidden.alias("hidden"))
        own = kept.select("entity_id", "public", "entity_type", F.explode(F.array(fields(DISPLAY, F.col("display"), none, no), fields(CANONICAL, F.col("canonical"), none, no))).alias("x"))
        further = aliases.select("entity_id", fields(ALIAS, F.col("alias"), F.col("alias_id").cast("long"), F.col("kind").eqNullSafe(hidden)).alias("x"))
        further = further.join(kept.select("entity_id", "public", "entity_type"), "entity_id").select("entity_id", "public", "entity_type", "x")
        rows = own.unionByName(further).select("entity_id", "public", "entity_type", "x.*").filter("name IS NOT NULL").withColumn("low", lowered(F.col("name")))
        key = F.xxhash64("low")
        names = rows.select(key.alias("key"), "low", "source", "entity_id", "alias_id", fold_dashes(F.col("name")).alias("shown"), "hidden", "public", "entity_type", F.pmod(key, F.lit(BUCKETS)).cast("int").alias("bucket"))
        names.repartitionByRange("bucket", "key", "entity_id").sortWithinPartitions("bucket", "key").write.mode("error").partitionBy("bucket").parquet(f"{self.path}/names")
        found = self._read("names", NAMES).select("key", "low").distinct()
        runs = F.array_distinct(F.flatten(F.array(*[grams_of(F.col("low"), n) for n in range(1, LONGEST_GRAM + 1)])))
        posted = found.select(F.explode(runs).alias("gram"), "key")
        posted.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key").write.mode("error").parquet(f"{self.path}/postings")
        counted = self._read("postings", POSTINGS).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        counted.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("error").parquet(f"{self.path}/counts")
        sorted_name = sort_key(folded(F.col("public")))
        listed = kept.select("entity_id", "public", "entity_type").distinct().withColumn("__k", sorted_name)
        listed.select("entity_id", "public", "entity_type", F.col("__k.script").alias("script"), F.col("__k.key").alias("sort")).write.mode("error").parquet(f"{self.path}/entities")
        return self

    def candidates(self, query: str) -> tuple[DataFrame, int]:
        """(keys of the names that hold the query's rarest grams, a bound of their number); the query is folded and not blank."""
        size = min(LONGEST_GRAM, len(query))
        grams = sorted({query[i : i + size] for i in range(len(query) - size + 1)})
        counts = {r.gram: r.n for r in self._read("counts", COUNTS).filter(F.col("gram").isin(grams)).collect()}  # a row a gram of the query
        postings = self._read("postings", POSTINGS)
        if len(counts) < len(grams):
            return postings.filter(F.lit(False)).select("key"), 0
        probes = sorted(grams, key=lambda g: (counts[g], g))[:PROBES]
        held = postings.filter(F.col("gram").isin(probes)).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        return held.filter(F.col("n") >= len(probes)).select("key"), counts[probes[0]]

    def matches(self, query: str) -> DataFrame:
        """The names that hold a query which is not blank, with `rank`: 1 to 3 equal (display, canonical, alias), 4 and 5 a beginning (name, alias), 6 and 7 within."""
        q = folded_query(query)
        keys, most = self.candidates(q)
        keys = keys.withColumn("bucket", F.pmod("key", F.lit(BUCKETS)).cast("int"))
        names = self._read("names", NAMES)
        rows = names.join(F.broadcast(keys) if most <= BROADCAST_KEYS else keys, ["bucket", "key"], "left_semi").filter(F.contains("low", F.lit(q)))
        alias = (F.col("source") == ALIAS).cast("int")
        return rows.withColumn("rank", F.when(F.col("low") == q, F.col("source")).when(F.startswith("low", F.lit(q)), alias + 4).otherwise(alias + 6))

    def lookup(self, query: str, entity_type: str | None = None) -> DataFrame:
        """(entity_id, rank, public, matched_alias): the entities, of one type or all, that a query finds, each at its best rank.

        `matched_alias` stands where an alias gave the rank: of the aliases that match and are not hidden the
        best by rank, folded name and id; else null. A blank query finds all, at rank 0.
        """
        of_type = F.lit(True) if not entity_type else F.col("entity_type") == entity_type
        if not query.strip():
            return self._read("entities", ENTITIES).filter(of_type).select("entity_id", F.lit(0).alias("rank"), "public", F.lit(None).cast("string").alias("matched_alias"))
        shown = F.when((F.col("source") == ALIAS) & ~F.col("hidden"), F.struct("rank", "low", "alias_id", "shown"))
        best = self.matches(query).filter(of_type).groupBy("entity_id", "public").agg(F.min("rank").alias("rank"), F.min(shown).alias("x"))
        return best.select("entity_id", "rank", "public", F.when(F.col("rank").isin(3, 5, 7), F.col("x.shown")).alias("matched_alias"))

    def page(self, query: str, number: int = 1, size: int = 48, entity_type: str | None = None) -> tuple[DataFrame, int, int]:
        """(the page's rows with `place`, its number, the number of all): cut after ranking, numbers clamped to the pages there are.

        A query's results go by rank, public name in lower case and id; those of a blank one in the order of
        names, Hebrew first. Places come from ranges: no task and no driver holds the pages before.
        """
        if size < 1:
            raise ValueError("a page has at least one row")
        if query.strip():
            rows, order = self.lookup(query, entity_type).withColumn("__name", F.lower("public")), ["rank", "__name", "entity_id"]
        else:
            sorts = self._read("entities", ENTITIES).select("entity_id", "script", F.col("sort").alias("__name"))
            rows, order = self.lookup(query, entity_type).join(sorts, "entity_id"), ["script", "__name", "entity_id"]
        placed = cut(with_places(rows, order))
        total = placed.count()
        number = min(max(1, number), max(1, -(-total // size)))
        within = F.col("place").between((number - 1) * size + 1, number * size)
        return placed.filter(within).select("place", "entity_id", "rank", "public", "matched_alias"), number, total
