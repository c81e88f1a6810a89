"""Quality rules by cross-document line frequency.

Lines are normalised (A-Z to lower case, blanks collapsed, ends trimmed) and hashed. For each host the
documents that hold a line are counted, documents of one and the same text once. Lines in more documents
than the host's limit are removed, and documents that lose too many of their words are rejected.

The text is read once, into a table of hashes and counts per document; all that is shuffled later is
that table's. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stage_table, unused, whole

#: A line is removed in a host if more than min(MAX_DOCS, max(MIN_DOCS, MAX_SHARE * different texts of the host)) different texts hold it.
MIN_DOCS = 10
MAX_SHARE = 0.01
MAX_DOCS = 10_000
#: Frequent lines that are broadcast; with more of them only those of the most texts are, and the others are joined by shuffle.
BROADCAST_LINES = 1_000_000
#: A document is rejected if less than this share of its words is left.
KEEP_SHARE = 0.5
MIN_WORDS = 20
WINDOW = 8
REPEAT_SHARE = 0.3
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once even where inner lambdas use it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(hashes: Column, n: Column) -> Column:
    """Hash of the window that starts at each word; hashes: one of each word."""
    ends = F.sequence(F.lit(1), n.cast("int") - (WINDOW - 1))
    return _let(hashes, lambda own: F.transform(ends, lambda i: F.xxhash64(F.slice(own, i, WINDOW))))


def _repeat_words(windows: Column) -> Column:
    """Ascending starts of the windows that occur twice or more."""
    same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    again = _let(
        pairs,
        lambda own: F.filter(
            own, lambda s, k: ((k > 0) & same(F.get(own, F.greatest(k - 1, F.lit(0))), s)) | same(F.get(own, k + 1), s)
        ),
    )
    return F.sort_array(F.transform(again, lambda s: s["i"]))


def _covered(starts: Column) -> Column:
    """Length of the union of [start, start + WINDOW) over ascending starts."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct((s + WINDOW).alias("end"), (a["n"] + F.least(F.lit(WINDOW), s + WINDOW - a["end"])).cast("long").alias("n")),
        lambda a: a["n"],
    )


def normal_lines(text: Column) -> Column:
    """The text's lines in normal form, blank ones as ''."""
    one = F.translate(F.translate(text, UPPER, LOWER), SPACES.replace("\n", ""), " " * 5)
    return F.transform(F.split(F.regexp_replace(one, " {2,}", " "), "\n"), lambda x: F.trim(x))


def profile(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: id, host, content hash, the word counts of the base rules, and (hash, words) of each line."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text.alias("text"))
    split = base.select(
        "id", "host", "text",
        F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0).alias("raw"),
        F.filter(normal_lines(F.col("text")), lambda x: x != "").alias("normal"),
    )
    hashed = split.select(
        "id", "host", "text", "raw", "normal", F.size("words").cast("long").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    seen = hashed.select(
        "id", "host", "text", "raw", "normal", "n_words",
        F.when(F.col("n_words") >= WINDOW, _windows(F.col("hashes"), F.col("n_words"))).otherwise(F.array().cast("array<bigint>")).alias("windows"),
    )
    length = F.length("text")
    return seen.select(
        "id", "host", F.xxhash64("text").alias("content"), F.monotonically_increasing_id().alias("row"), "n_words",
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (length - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("windows")) == F.size("windows"), F.lit(0).cast("long"))
        .otherwise(_covered(_repeat_words(F.col("windows")))).alias("n_repeat_words"),
        F.transform(
            "normal",
            lambda x: F.struct(F.xxhash64(x).alias("h"), (F.length(x) - F.length(F.translate(x, " ", "")) + 1).alias("w")),
        ).alias("lines"),
    )


def _hits(occurrences: DataFrame, frequent: DataFrame, broadcast_lines: int) -> DataFrame:
    """Occurrences of frequent lines. The lines of the most texts, which are hot keys, are always broadcast."""
    same = (F.col("h") == F.col("__h")) & F.col("host").eqNullSafe(F.col("__host"))
    if frequent.count() <= broadcast_lines:
        return occurrences.join(F.broadcast(frequent), same)
    # a line's power of two is its class; whole classes are broadcast from the top, as many as fit
    classes = frequent.groupBy(F.floor(F.log2("n")).alias("c")).count().orderBy(F.desc("c")).collect()  # 64 rows at most
    fit, low = broadcast_lines, 64
    for r in classes:
        fit -= r["count"]
        if fit < 0:
            break
        low = r["c"]
    hot = F.floor(F.log2("n")) >= low
    return occurrences.join(F.broadcast(frequent.filter(hot)), same).unionByName(occurrences.join(frequent.filter(~hot), same))


def line_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    max_docs: int = MAX_DOCS,
    keep_share: float = KEEP_SHARE,
    broadcast_lines: int = BROADCAST_LINES,
) -> DataFrame:
    """One row per row of `docs`: id, host, content (hash of the text), the base counts, base_failed,
    n_removed_words, removed (hashes of the removed lines, ascending), kept.

    A line's count is that of the different texts of the host that hold it, and its limit a share of the
    host's different texts, so that copies of a document are one document on both sides. A document is kept if it passes the base rules (MIN_WORDS words at least, at most
    REPEAT_SHARE of them in repeated windows of WINDOW words) and at least `keep_share` of its words is left.

    Null text: as the empty text, rejected for want of words. Null host: a host of its own. Null id: kept
    as it is. Repeated rows: judged alike. Empty table: empty result. Other columns are not read.
    """
    facts = stage_table(profile(docs, id_col=id_col, text_col=text_col, host_col=host_col), "line-profile")
    hosts = facts.select("host", "content").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    lines = facts.select("host", "content", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    # documents of one text fall together before lines are counted; what remains is summed on the map side
    counts = lines.distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs)
    limit = F.least(F.lit(float(max_docs)), F.lit(float(max_share)) * F.col("docs"))
    frequent = counts.join(hosts.withColumnRenamed("host", "__host"), F.col("host").eqNullSafe(F.col("__host"))).filter(F.col("n") > limit)
    frequent = stage_table(frequent.select("__host", F.col("h").alias("__h"), "n"), "frequent-lines")
    occurrences = facts.select("row", "host", F.explode("lines").alias("x")).select("row", "host", "x.h", "x.w")
    hits = _hits(occurrences, frequent, broadcast_lines)
    removed = hits.groupBy("row").agg(
        F.sum("w").cast("long").alias("n_removed_words"), F.sort_array(F.collect_set("h")).alias("removed")
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * REPEAT_SHARE) * F.col("n_words"))
    n_removed = F.coalesce(F.col("n_removed_words"), F.lit(0).cast("long"))
    return (
        facts.drop("lines").join(removed, "row", "left")
        .withColumn("base_failed", failed)
        .withColumn("n_removed_words", n_removed)
        .withColumn("removed", F.coalesce("removed", F.array().cast("array<bigint>")))
        .withColumn("kept", ~failed & (F.col("n_words") - n_removed >= F.lit(float(keep_share)) * F.col("n_words")))
        .drop("row")
    )


def cleaned_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """The kept documents in the columns of `docs`, without the lines above the limits in their texts.

    Rows that are repeated stay repeated. Nulls and ties: as in `line_rules`.
    """
    ruled = line_rules(docs, id_col=id_col, text_col=text_col, host_col=host_col, **limits).filter("kept")
    (found,) = unused(docs, "found")
    ruled = ruled.groupBy("id", "host", "content").agg(F.first("removed").alias("removed")).select(F.struct("*").alias(found))  # equal keys are equal rows
    rule, text = F.col(found), F.col(text_col)
    joined = docs.join(
        ruled, F.col(id_col).eqNullSafe(rule["id"]) & (F.xxhash64(F.coalesce(text, F.lit(""))) == rule["content"]) & F.col(host_col).eqNullSafe(rule["host"])
    )
    paired = F.arrays_zip(F.split(text, "\n").alias("raw"), F.transform(normal_lines(text), lambda x: F.xxhash64(x)).alias("h"))
    left = F.array_join(F.transform(F.filter(paired, lambda z: ~F.array_contains(rule["removed"], z["h"])), lambda z: z["raw"]), "\n")
    cleaned = F.when(F.size(rule["removed"]) > 0, left).otherwise(text)
    return joined.select(*[cleaned.alias(name) if name == text_col else c for c, name in zip(whole(docs), docs.columns, strict=True)])


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_columns

    ruled = line_rules(read_columns(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return ruled.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "n_removed_words", "kept",
    )


_WS = "\\x20\\x09-\\x0D"
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^{_WS}]+') AS words FROM documents),
win AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS w, len(words) AS n
        FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + j)::BIGINT AS n FROM rep, range(0, 8) t(j) GROUP BY r),
raw AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
dup AS (SELECT r, (count(*) - count(DISTINCT line))::BIGINT AS n FROM raw WHERE regexp_matches(line, '[^{_WS}]') GROUP BY r),
norm AS (
  SELECT r, source, text, trim(regexp_replace(translate(translate(line, '{UPPER}', '{LOWER}'),
         chr(9) || chr(11) || chr(12) || chr(13), '    '), ' {{2,}}', ' ', 'g'), ' ') AS line FROM raw),
cnt AS (SELECT source, line, count(DISTINCT text) AS n FROM norm WHERE line <> '' GROUP BY source, line),
host AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
freq AS (SELECT c.source, c.line FROM cnt c JOIN host h ON c.source IS NOT DISTINCT FROM h.source
         WHERE c.n > {MIN_DOCS} AND c.n > least({MAX_DOCS}::DOUBLE, {MAX_SHARE}::DOUBLE * h.docs)),
gone AS (SELECT m.r, sum(length(m.line) - length(replace(m.line, ' ', '')) + 1)::BIGINT AS n
         FROM norm m JOIN freq f ON m.source IS NOT DISTINCT FROM f.source AND m.line = f.line GROUP BY m.r),
a AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM d LEFT JOIN cov USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {int(100 * REPEAT_SHARE)} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {int(100 * REPEAT_SHARE)} * n_words)
       AND (n_words - n_removed_words)::DOUBLE >= {KEEP_SHARE}::DOUBLE * n_words AS kept
FROM a
"""
