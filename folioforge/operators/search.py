"""Weighted search over title, metadata and body: terms, matches, relevance, pages, facets, snippets."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import bound, collapse, tokens

MAX_QUERY = 200
#: Weights of a field in which all terms of the query stand, and of a term within title or metadata.
TITLE, META, BODY = 1.0, 0.4, 0.2
TITLE_BOOST, META_BOOST = 1.0, 0.4
PAGE_SIZES, DEFAULT_PAGE = (24, 48, 96), 48
#: Files of the index are parted by this many buckets of tokens.
BUCKETS = 64
#: Postings of a task that writes them, about; a bucket of more is dealt by item to several.
TASK_POSTINGS = 3_000_000


def terms(query: str) -> list[str] | None:
    """Lower-case terms; None for a blank query, an empty list for one that matches nothing."""
    query = query.strip()
    if not query:
        return None
    if len(query) > MAX_QUERY:
        return []
    out, word = [], ""
    for ch in query.lower() + " ":
        if ch.isalnum():
            word += ch
        elif word:
            out.append(word)
            word = ""
    return list(dict.fromkeys(out))


def search(items: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """`items` that match every term, with `relevance`. index: postings of the items, as `stored_index` gives them.

    A term matches as a token of any field or as a substring of title or metadata. Tokens come from the
    postings of the query's terms alone, and substrings from a scan of the two short fields: no body is read.
    """
    wanted = terms(query)
    if wanted is None:
        return items.withColumn("relevance", F.lit(0.0))
    if not wanted:
        return items.withColumn("relevance", F.lit(0.0)).filter(F.lit(False))
    weights = {"A": TITLE, "B": META, "C": BODY}
    found = postings_of(index, wanted).groupBy("item_id").agg(F.collect_set("token").alias("__tokens"), *[F.count_if(F.col("field") == f).alias(f"__{f}") for f in weights])
    inside = {(f, t): F.coalesce(F.contains(F.lower(f), F.lit(t)), F.lit(False)) for f in ("title", "metadata") for t in wanted}
    every: Column = F.lit(True)
    for t in wanted:
        every &= F.coalesce(F.array_contains("__tokens", t), F.lit(False)) | inside["title", t] | inside["metadata", t]
    rank: Column = F.lit(0.0)
    for f, weight in weights.items():  # a field's postings are one a token: as many as terms are all of them
        rank += F.when(F.col(f"__{f}") == len(wanted), weight).otherwise(0.0)
    for f, weight in (("title", TITLE_BOOST), ("metadata", META_BOOST)):
        some: Column = F.lit(False)
        for t in wanted:
            some |= inside[f, t]
        rank += F.when(some, weight).otherwise(0.0)
    rows = items.join(found, "item_id", "left").filter(every)
    return rows.withColumn("relevance", F.round(rank, 6)).select(*items.columns, "relevance")


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = DEFAULT_PAGE) -> DataFrame:
    """One page in a total order; sizes other than the allowed ones become the default."""
    size = size if size in PAGE_SIZES else DEFAULT_PAGE
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size)


def clamped_page(rows: DataFrame, order: list[Column], number: int = 1, size: int = DEFAULT_PAGE) -> tuple[DataFrame, int, int]:
    """(the page, its number, the number of rows): a number beyond the last page is the last, one below the first is the first."""
    size = size if size in PAGE_SIZES else DEFAULT_PAGE
    total = rows.count()
    number = min(max(1, number), max(1, -(-total // size)))
    return page(rows, order, number, size), number, total


def term_candidates(items: DataFrame, index: DataFrame, term: str) -> DataFrame:
    """Ids that match a term by token, by title or by metadata: a union of three arms."""
    token = postings_of(index, [term]).select("item_id").join(items.select("item_id"), "item_id", "left_semi")
    arms = [items.filter(F.contains(F.lower(f), F.lit(term))).select("item_id") for f in ("title", "metadata")]
    return token.unionByName(arms[0]).unionByName(arms[1]).distinct()


def type_counts(items: DataFrame) -> DataFrame:
    """Counts of all type tabs in one pass."""
    kind = F.col("item_type")
    return items.agg(
        F.count(F.lit(1)).alias("all_items"), F.count_if(kind.isin("DOCUMENT", "TEXT")).alias("documents_and_texts"),
        F.count_if(kind == "PHOTO").alias("photos"), F.count_if(kind == "VIDEO").alias("videos"),
    )


def facets(items: DataFrame, retired: list[str] = ()) -> DataFrame:
    """(dimension, choice): distinct values within the authorised items, without retired ones."""
    pairs = items.select(F.explode(F.create_map(*[x for c in ("author", "language", "item_type") for x in (F.lit(c), F.col(c))])).alias("dimension", "choice"))
    return pairs.filter(F.col("choice").isNotNull() & ~F.col("choice").isin(*retired) if retired else F.col("choice").isNotNull()).distinct()


def _runs(words: Column) -> Column:
    """The different words of an array in order, each with its number and first place: what follows one another in the sorted array is one word."""
    def counted(x: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda i: (i == 0) | (F.get(x, i)["token"] != F.get(x, i - 1)["token"]))
        one = lambda ends: lambda i, k: F.struct(
            F.get(x, i)["token"].alias("token"), (F.coalesce(F.get(ends, k + 1), F.size(x)) - i).cast("long").alias("n"), F.get(x, i)["at"].cast("long").alias("first")
        )
        return bound(at, lambda ends: F.transform(ends, one(ends)))

    return bound(F.sort_array(F.transform(words, lambda w, i: F.struct(w.alias("token"), i.alias("at")))), lambda x: F.when(F.size(x) > 0, counted(x)))


def counted_tokens(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """(item_id, token, field, n, first) of the texts of `rows` (item_id, …) by field; a null text has none.

    The tokens of a row are counted within the row, so that nothing is shuffled. Only the rows of an id that
    several rows have are met by a grouping; ids alone are read to find them.
    """
    repeated = rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(F.col("item_id").alias("__id"))
    texts = F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.coalesce(text, F.lit(""))).alias("tokens")) for f, text in fields.items()])

    def of(some: DataFrame) -> DataFrame:
        per = some.select("item_id", F.explode(texts).alias("x"))
        return per.select("item_id", "x.field", F.explode(_runs(F.col("x.tokens"))).alias("t")).select("item_id", "t.token", "field", "t.n", "t.first")

    if repeated.isEmpty():
        return of(rows)
    same = F.col("item_id").eqNullSafe(F.col("__id"))
    several = of(rows.join(repeated, same, "left_semi")).groupBy("item_id", "token", "field").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
    return of(rows.join(repeated, same, "left_anti")).unionByName(several)


def postings(items: DataFrame) -> DataFrame:
    """(item_id, token, field, n, first): the index that a search document becomes."""
    return counted_tokens(items, {"A": F.col("title"), "B": F.col("metadata"), "C": F.col("body")})


def documents(items: DataFrame, *, authors: DataFrame, labels: dict[str, DataFrame], persons: DataFrame) -> DataFrame:
    """(item_id, title, metadata): what is searched of each item besides its texts, in lines; blanks collapsed, empties and repeats dropped.

    items: item_id, title, author (a legacy name), source, note. authors: item_id, position, name. labels: name
    of a kind (categories, events, tags, in this order) -> item_id, name. persons: item_id, person_id, name,
    others (aliases, then family names). Order: authors by position, or else the legacy name; source;
    labels by kind and name; note; persons by name. Each side becomes one array an item before it is joined.
    """
    def listed(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
        own = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("__v"))))
        return rows.groupBy("item_id").agg(F.transform(own, lambda x: x["__v"]).alias(name))

    rows, none = items, F.array().cast("array<string>")
    people = persons.withColumn("lines", F.concat(F.array("name"), F.coalesce("others", none)))
    sides = {"__authors": listed(authors, ["position"], "name", "__authors"), "__people": listed(people, ["name", "person_id"], "lines", "__people")}
    sides |= {f"__{k}": listed(side, ["name"], "name", f"__{k}") for k, side in labels.items()}
    for side in sides.values():
        rows = rows.join(side, "item_id", "left")
    held = lambda name: F.coalesce(name, none)
    written = F.when(F.size(held("__authors")) > 0, F.col("__authors")).otherwise(F.array("author"))
    parts = F.concat(written, F.array("source"), *[held(f"__{k}") for k in labels], F.array("note"), F.coalesce(F.flatten("__people"), none))
    clean = F.filter(F.transform(parts, lambda x: collapse(F.coalesce(x, F.lit("")))), lambda x: x != "")
    return rows.select("item_id", collapse(F.coalesce("title", F.lit(""))).alias("title"), F.array_join(F.array_distinct(clean), "\n").alias("metadata"))


def bucket_of(token: Column) -> Column:
    return (F.crc32(token.cast("binary")) % BUCKETS).cast("int")


def in_buckets(postings: DataFrame, about: int) -> DataFrame:
    """About so many postings (…, bucket), a bucket or a part of its items to a task, each sorted by token.

    Parts are told by the item, so that a token of very many items is many tasks; no ranges are looked for,
    for which the tokens of all texts would be made twice.
    """
    parts = max(1, -(-about // (BUCKETS * TASK_POSTINGS)))
    task = F.col("bucket") * parts + F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int")
    return postings.repartitionById(BUCKETS * parts, task).sortWithinPartitions("bucket", "token", "item_id")


def about_postings(rows: DataFrame, fields: list[str]) -> int:
    """The postings of texts, about: one for ten characters. It tells the number of tasks alone."""
    chars = rows.agg(F.sum(sum((F.length(F.coalesce(f, F.lit(""))) for f in fields), F.lit(0)))).first()[0]
    return (chars or 0) // 10


def write_index(items: DataFrame, path: str) -> None:
    """The postings as files by bucket of the token, sorted by token: a query opens the buckets of its terms and skips to them."""
    keyed = postings(items).withColumn("bucket", bucket_of(F.col("token")))
    in_buckets(keyed, about_postings(items, ["body"])).write.partitionBy("bucket").mode("overwrite").parquet(path)


def postings_of(index: DataFrame, wanted: list[str]) -> DataFrame:
    """The postings of some tokens; files of other buckets are not opened."""
    if "bucket" in index.columns:
        index = index.filter(F.col("bucket").isin(*{zlib.crc32(t.encode()) % BUCKETS for t in wanted}))
    return index.filter(F.col("token").isin(*wanted))


def refreshed(index: DataFrame, items: DataFrame, ids: DataFrame) -> DataFrame:
    """`index` with the postings of the given ids (item_id, repeats and unknown ones allowed) made anew; an item that is gone has none."""
    wanted = ids.select("item_id").distinct()
    new = postings(items.join(wanted, "item_id", "left_semi"))
    return index.select(*new.columns).join(wanted, "item_id", "left_anti").unionByName(new)


def refresh_ids(*sides: DataFrame) -> DataFrame:
    """Distinct item ids of several sources, ascending: what a change of a person asks to be indexed anew."""
    ids = sides[0].select("item_id")
    for side in sides[1:]:
        ids = ids.unionByName(side.select("item_id"))
    return ids.distinct().orderBy("item_id")


def match_label(items: DataFrame, query: str) -> DataFrame:
    """(item_id, label): the one field in which a term stands, `several` or `none`."""
    wanted = terms(query) or []
    arms = {f: F.lit(False) for f in ("author", "language", "title")}
    for f in arms:
        for t in wanted:
            arms[f] |= F.coalesce(F.contains(F.lower(f), F.lit(t)), F.lit(False))
    hits = F.array_compact(F.array(*[F.when(c, f) for f, c in arms.items()]))
    return items.select("item_id", F.when(F.size(hits) == 1, hits[0]).when(F.size(hits) > 1, "several").otherwise("none").alias("label"))


def literal_matches(text: Column, term: str) -> Column:
    """Number of non-overlapping occurrences, case ignored."""
    low = F.lower(text)
    return ((F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / len(term)).cast("long")
