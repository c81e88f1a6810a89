"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key -ln(u) / w, where u comes from a hash of its id, its text and its
number among equal rows, and w is its quality weight; ascending keys are a weighted sample without
replacement. A source's target holds some complete epochs, in which each document is taken once; the rest
of the target is filled by prefix sums over the keys. Sums go by (source, key bucket) first, coarse and
fine, so that only the one bucket of a source in which its budget ends is ever sorted by rows: a source
with a third of all rows stays spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, stage_table, uniform

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Key buckets for each factor e between keys, whatever the weights: the fullest has 1/44,000 of a source's rows. FINE of them are a coarse one.
KEY_BUCKETS = 16384
FINE = 256
#: Weights are held between these.
LEAST_WEIGHT, MOST_WEIGHT = 1e-200, 1e200
SEED = "mix"
#: Characters that hardly occur in prose; their share lowers a document's quality weight.
JUNK = "#*$%&|<>{}[]~^_=+@\\"


def quality_weight(text: Column) -> Column:
    """1 for plain prose, down to 0.1 for text of which a fifth or more is junk characters; 1 for no text."""
    chars = F.length(text)
    junk = chars - F.length(F.translate(text, JUNK, ""))
    return F.coalesce(F.greatest(F.lit(0.1), F.lit(1.0) - F.lit(5.0) * junk / F.greatest(chars, F.lit(1))), F.lit(1.0))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> the same with `target`.

    Sources in code point order, null last, take the weights in turn. A target is min(cap, level * weight)
    for the one level at which all targets add up to share * total: what capped sources cannot take goes
    to the others by weight. One row per source meets in one task, never the documents.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("__w", w.cast("long")).withColumn("__cap", F.col("source_size") * max_epochs)
    by_fill = Window.orderBy((F.col("__cap") / F.col("__w")).asc(), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    ranked = (
        ranked.withColumn("__total", F.sum("source_size").over(whole))
        .withColumn("__full", F.coalesce(F.sum("__cap").over(before), F.lit(0)))
        .withColumn("__left", F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0)))
        .withColumn("__place", F.row_number().over(by_fill))
    )
    level = (F.lit(float(share)) * F.col("__total") - F.col("__full")) / F.col("__left")
    first_open = F.min(F.when(level * F.col("__w") <= F.col("__cap"), F.struct("__place", level.alias("level"))))
    ranked = ranked.withColumn("__level", first_open.over(whole)["level"])
    target = F.least(F.col("__cap").cast("double"), F.coalesce(F.col("__level"), F.lit(float("inf"))) * F.col("__w"))
    return ranked.select("source", "source_size", target.alias("target"))


def _measured(docs: DataFrame, id_col, text_col, source_col, weight) -> DataFrame:
    """Rows with doc (the whole row), id, source, __size, __weight and __same, which copies of id and text share, and of a caller's weight."""
    w = (quality_weight(F.col(text_col)) if weight is None else weight).cast("double")
    w = F.when((w > 0) & ~F.isnan(w), F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), w)))
    text = F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit("null"))
    parts = [F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(":"), text]
    if weight is not None:  # else it follows from the text
        parts += [F.lit(":"), F.coalesce(w.cast("string"), F.lit("null"))]
    same = F.md5(F.concat(*parts).cast("binary"))
    return docs.select(
        F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("__size"), w.alias("__weight"), same.alias("__same")
    )


def _copies(slim: DataFrame) -> DataFrame | None:
    """The (__source, __twin) of which there are several rows; None if there is none."""
    several = slim.groupBy("source", "__same").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = stage_table(several.select(F.col("source").alias("__source"), F.col("__same").alias("__twin")), "mix-copies")
    return None if several.isEmpty() else several


def _keyed(rows: DataFrame, copies: DataFrame | None, key_buckets: int, seed: str) -> DataFrame:
    """`rows` with __number, 0 and on among copies of a row, and the __key and __bucket that follow from it.

    Numbers go on from partition to partition, so that no copies need to meet in one task. Which of them
    has which number does not matter: they are equal in id, source and text.
    """
    if copies is None:
        numbered = rows.withColumn("__number", F.lit(0).cast("long"))
    else:
        twins = F.col("source").eqNullSafe(F.col("__source")) & (F.col("__same") == F.col("__twin"))
        single = rows.join(copies, twins, "left_anti").withColumn("__number", F.lit(0).cast("long"))
        several = stage_table(rows.join(copies, twins, "left_semi").withColumn("__part", F.spark_partition_id()), "mix-several")
        by_part = several.groupBy("source", "__same", "__part").agg(F.count(F.lit(1)).alias("__n"))
        before = Window.partitionBy("source", "__same").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
        firsts = by_part.select(F.col("source").alias("__source"), F.col("__same").alias("__twin"), F.col("__part").alias("__at"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
        own = F.row_number().over(Window.partitionBy("source", "__same", "__part").orderBy("__part")) - 1
        placed = several.withColumn("__own", own).join(firsts, twins & (F.col("__part") == F.col("__at")))
        numbered = single.unionByName(placed.withColumn("__number", F.col("__first") + F.col("__own")).select(*single.columns))
    u = uniform(F.concat("__same", F.lit(":"), F.col("__number").cast("string")), seed)
    key = -F.ln(u) / F.coalesce(F.col("__weight"), F.lit(1.0))
    # rows without a weight come after all others, spread in the same way
    bucket = F.floor(F.ln("__key") * key_buckets) + F.when(F.col("__weight").isNull(), F.lit(1 << 40)).otherwise(F.lit(0))
    return numbered.withColumn("__key", key).withColumn("__bucket", bucket.cast("long")).drop("__weight")


def mix_plan(keyed: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source_size, target, epochs, and the last (key, copies, number) that the fractional part takes.

    The budget's coarse bucket is found from sums, then its fine one; only that one's rows are sorted.
    """
    tallies = stage_table(keyed.groupBy("source", "__bucket").agg(F.sum("__size").alias("__words")), "mix-tallies")
    sizes = tallies.groupBy("source").agg(F.sum("__words").alias("source_size"))
    targets = (
        source_targets(sizes, weights, share, max_epochs)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumnRenamed("source", "__source")
    )
    targets = stage_table(targets, "mix-targets")
    of_source = F.col("source").eqNullSafe(F.col("__source"))
    coarse = F.floor(F.col("__bucket") / FINE)

    def cut(sums: DataFrame, at: str) -> DataFrame:
        """(__s, __b, __start): the first `at` of each source whose end is beyond the budget, and the words before it."""
        running = Window.partitionBy("source").orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ends = sums.withColumn("__end", F.col("__before") + F.sum("__words").over(running)).join(targets, of_source).filter(F.col("__end") > F.col("rest"))
        first = ends.groupBy("source").agg(F.min(F.struct(F.col(at).alias("b"), (F.col("__end") - F.col("__words")).alias("start"))).alias("cut"))
        return stage_table(first.select(F.col("source").alias("__s"), F.col("cut.b").alias("__b"), F.col("cut.start").alias("__start")), "mix-cuts")

    of_cut = F.col("source").eqNullSafe(F.col("__s"))
    wide = tallies.groupBy("source", coarse.alias("__coarse")).agg(F.sum("__words").alias("__words")).withColumn("__before", F.lit(0).cast("long"))
    fine = tallies.join(cut(wide, "__coarse"), of_cut & (coarse == F.col("__b"))).select("source", "__bucket", "__words", F.col("__start").alias("__before"))
    cuts = cut(fine, "__bucket")
    rows = keyed.join(cuts, of_cut & (F.col("__bucket") == F.col("__b")))
    order = ["__key", "__same", "__number"]
    before = Window.partitionBy("source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("__start") + F.coalesce(F.sum("__size").over(before), F.lit(0)) + F.col("__size") / 2.0
    inside = rows.withColumn("__middle", middle).join(targets, of_source).filter(F.col("__middle") <= F.col("rest"))
    last = inside.groupBy("source").agg(F.max(F.struct(*order)).alias("last"))
    plan = (
        targets.join(cuts, F.col("__source").eqNullSafe(F.col("__s")), "left")
        .join(last, F.col("__source").eqNullSafe(F.col("source")), "left")
        .select("__source", "source_size", "target", "epochs", "rest", F.col("__b").alias("cut"), "last")
    )
    return stage_table(plan, "mix-plan")  # small: Catalyst broadcasts it if its files are below the session's threshold


def _decided(keyed: DataFrame, plan: DataFrame, max_epochs: int) -> DataFrame:
    """`keyed` with the plan's columns and __times, how often the mix takes the row."""
    joined = keyed.join(plan, F.col("source").eqNullSafe(F.col("__source")))
    at_cut = F.coalesce(F.struct("__key", "__same", "__number") <= F.col("last"), F.lit(False))
    inside = F.col("cut").isNull() | (F.col("__bucket") < F.col("cut")) | ((F.col("__bucket") == F.col("cut")) & at_cut)
    selected = inside & (F.col("epochs") < max_epochs) & (F.col("rest") > 0)
    return joined.withColumn("__times", F.col("epochs") + selected.cast("long"))


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    weights=WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    key_buckets: int = KEY_BUCKETS,
    seed: str = SEED,
) -> DataFrame:
    """One row per row of `docs`: id, source, size, source_size, target, times, taken.

    size: words of the text (null or empty: 0). times: complete passes over the source, and one more if the
    document is in the part that fills the rest of the target; a document is in if less than half of it
    lies beyond. taken = size * times, at most max_epochs * size.

    Null source: a source of its own, last. Null id: hashed as the text "null". Null, non-positive or NaN
    weight: after all rows with a weight, in random order. Rows with one id, or none, and different texts
    draw keys of their own; so do repeated rows, each by its number among them. Empty table: empty result.
    Other columns are not read. Same input, same result: keys are hashes.
    """
    slim = stage_table(_measured(docs, id_col, text_col, source_col, weight).drop("doc"), "mix-sizes")
    keyed = _keyed(slim, _copies(slim), key_buckets, seed)
    decided = _decided(keyed, mix_plan(keyed, weights, share, max_epochs), max_epochs)
    return decided.select(
        "id", "source", F.col("__size").alias("size"), "source_size", "target", F.col("__times").alias("times"),
        (F.col("__size") * F.col("__times")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weight: Column | None = None,
    weights=WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    key_buckets: int = KEY_BUCKETS,
    seed: str = SEED,
) -> DataFrame:
    """The mixture itself: each document as often as the mix takes it, in the columns of `docs`. Cases: as in `mix`."""
    wide = _measured(docs, id_col, text_col, source_col, weight)
    slim = stage_table(wide.drop("doc"), "mix-sizes")
    copies = _copies(slim)
    plan = mix_plan(_keyed(slim, copies, key_buckets, seed), weights, share, max_epochs)
    times = F.when(F.col("__size") > 0, F.col("__times")).otherwise(0).cast("int")
    decided = _decided(_keyed(wide, copies, key_buckets, seed), plan, max_epochs)
    return decided.select("doc", F.explode(F.array_repeat(F.lit(0), times))).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_columns

    mixed = mix(read_columns(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


SQL = """
WITH d AS (
  SELECT doc_id, source, text,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         coalesce(greatest(0.1::DOUBLE, 1.0::DOUBLE - 5.0::DOUBLE * (length(text) - length(translate(text, '#*$%&|<>{}[]~^_=+@\\', '')))
                  / greatest(length(text), 1)), 1.0::DOUBLE) AS w,
         md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')) AS same,
         row_number() OVER (PARTITION BY doc_id, text, source) - 1 AS number,
         (('0x' || substr(md5(same || ':' || number || ':mix'), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (CASE (row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS wt,
             2 * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
                 - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
                / ((sum(wt) OVER ())::DOUBLE - coalesce(sum(wt) OVER (ORDER BY cap::DOUBLE / wt, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) AS lv,
             row_number() OVER (ORDER BY cap::DOUBLE / wt, source NULLS LAST) AS place
      FROM r),
m AS (SELECT arg_min(lv, place) FILTER (lv * wt <= cap) AS level FROM l),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(level, 'infinity'::DOUBLE) * wt) AS target FROM l, m),
e AS (SELECT *, (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::BIGINT AS epochs FROM t),
k AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.w, d.same, d.number
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0::DOUBLE AS mid
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN epochs < 2 AND rest > 0 AND mid <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM k
"""
