"""String, date, geometry and ordered-text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import dates, text
from folioforge.operators import ordered
from folioforge.registry import query
from folioforge.sources.tables import table

_DATES = """d AS (SELECT o_orderkey, ['DAY', 'MONTH', 'YEAR', 'RANGE_YEAR', 'UNKNOWN'][o_orderkey % 5 + 1] AS precision, year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m,
  (o_orderkey % 31 + 1)::INT AS dd, (year(o_orderdate) + o_orderkey % 3)::INT AS y2 FROM orders),
b AS (SELECT *, CASE WHEN precision IN ('YEAR', 'RANGE_YEAR') THEN make_date(y, 1, 1) WHEN precision = 'MONTH' THEN make_date(y, m, 1)
  WHEN precision = 'DAY' AND dd <= day(last_day(make_date(y, m, 1))) THEN make_date(y, m, CASE WHEN dd <= day(last_day(make_date(y, m, 1))) THEN dd ELSE 1 END) END AS lo FROM d),
n AS (SELECT *, CASE precision WHEN 'RANGE_YEAR' THEN make_date(y2, 12, 31) WHEN 'YEAR' THEN make_date(y, 12, 31) WHEN 'MONTH' THEN last_day(lo) ELSE lo END AS hi FROM b)"""


def bounds(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"]).select(
        "o_orderkey", F.element_at(F.array(*map(F.lit, dates.PRECISIONS)), (k % 5 + 1).cast("int")).alias("precision"), F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"),
        (k % 31 + 1).cast("int").alias("dd"), (F.year("o_orderdate") + k % 3).cast("int").alias("y2"),
    )
    c = F.col
    return rows.withColumn("lo", dates.start_bound(c("precision"), c("y"), c("m"), c("dd"))).withColumn("hi", dates.end_bound(c("precision"), c("y"), c("m"), c("dd"), c("y2")))


@query("date_bounds", f"WITH {_DATES} SELECT o_orderkey, precision, lo::VARCHAR AS lo, hi::VARCHAR AS hi FROM n")
def _(spark, sf_dir):
    return bounds(spark, sf_dir).select("o_orderkey", "precision", F.col("lo").cast("string").alias("lo"), F.col("hi").cast("string").alias("hi"))


@query("date_overlap_by_precision", f"WITH {_DATES} SELECT o_orderkey FROM n WHERE precision <> 'UNKNOWN' AND lo IS NOT NULL AND hi IS NOT NULL AND lo <= DATE '1997-12-31' AND hi >= DATE '1996-01-01'")
def _(spark, sf_dir):
    return bounds(spark, sf_dir).filter(dates.overlaps(F.col("precision"), F.col("lo"), F.col("hi"), 1996, 1997)).select("o_orderkey")


@query(
    "date_labels",
    f"""WITH {_DATES} SELECT o_orderkey, CASE precision WHEN 'YEAR' THEN strftime(lo, '%Y') WHEN 'MONTH' THEN strftime(lo, '%m/%Y') WHEN 'DAY' THEN strftime(lo, '%d/%m/%Y')
  WHEN 'RANGE_YEAR' THEN strftime(lo, '%Y') || '-' || strftime(hi, '%Y') ELSE '' END AS label FROM n""",
)
def _(spark, sf_dir):
    return bounds(spark, sf_dir).select("o_orderkey", dates.label(F.col("precision"), F.col("lo"), F.col("hi")).alias("label"))


@query(
    "script_dominance",
    """WITH n AS (SELECT doc_id, length(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\\S+|\\S+@\\S+', ' ', 'g'), '[^\\p{Latin}]', '', 'g'))::BIGINT AS latin,
  length(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\\S+|\\S+@\\S+', ' ', 'g'), '[^\\p{Hebrew}]', '', 'g'))::BIGINT AS hebrew FROM documents)
SELECT *, CASE WHEN latin + hebrew = 0 THEN 'none' WHEN 10 * hebrew >= 9 * (latin + hebrew) THEN 'hebrew' WHEN 10 * latin >= 9 * (latin + hebrew) THEN 'latin' ELSE 'mixed' END AS dominance FROM n""",
)
def _(spark, sf_dir):
    body = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", text.script_letters(body, "IsLatin").alias("latin"), text.script_letters(body, "IsHebrew").alias("hebrew"))
    both = F.col("latin") + F.col("hebrew")
    return rows.withColumn("dominance", F.when(both == 0, "none").when(10 * F.col("hebrew") >= 9 * both, "hebrew").when(10 * F.col("latin") >= 9 * both, "latin").otherwise("mixed"))


@query("hebrew_sort_key")
def _(spark, sf_dir):
    names = table(spark, sf_dir, "customer", ["c_custkey", "c_name"]).withColumn("name", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("«שלום־ם "), "c_name")).otherwise(F.col("c_name")))
    return names.select("c_custkey", text.sort_key(text.folded("name")).alias("k")).select("c_custkey", "k.script", "k.key")


@query(
    "line_whitespace",
    """SELECT doc_id, sha256(array_to_string(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ')), chr(10))) AS sha FROM documents""",
)
def _(spark, sf_dir):
    return table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", F.sha2(text.normal_whitespace(F.coalesce("text", F.lit(""))), 256).alias("sha"))


@query(
    "ordered_names",
    """WITH p AS (SELECT doc_id, list_transform(string_split(coalesce(text, ''), ','), lambda x: trim(x, ' ')) AS x FROM documents),
u AS (SELECT doc_id, unnest(x) AS name, unnest(range(len(x))) AS k FROM p), f AS (SELECT doc_id, name, min(k) AS k FROM u WHERE name <> '' GROUP BY ALL)
SELECT doc_id, count(*)::BIGINT AS n, sha256(string_agg(name, '|' ORDER BY k)) AS names FROM f GROUP BY doc_id""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", text.ordered_names(F.coalesce("text", F.lit(""))).alias("names"))
    return rows.filter(F.size("names") > 0).select("doc_id", F.size("names").cast("long").alias("n"), F.sha2(F.array_join("names", "|"), 256).alias("names"))


@query("json_reasons", """SELECT json_extract(props, '$.k')::BIGINT AS k, count(*)::BIGINT AS n FROM events GROUP BY 1""")
def _(spark, sf_dir):
    events = table(spark, sf_dir, "events", ["props"]).select(F.from_json("props", "k bigint").alias("p"))
    return events.groupBy("p.k").agg(F.count(F.lit(1)).alias("n"))


@query(
    "page_links",
    """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1)) AS label FROM pages) SELECT page_id, label, count(*)::BIGINT AS n FROM l GROUP BY ALL""",
)
def _(spark, sf_dir):
    links = table(spark, sf_dir, "pages", ["page_id", "html"]).select("page_id", F.explode(F.regexp_extract_all("html", F.lit("<a [^>]*>([^<]*)</a>"), F.lit(1))).alias("label"))
    return links.groupBy("page_id", "label").agg(F.count(F.lit(1)).alias("n"))


@query("page_texts", """SELECT page_id, array_to_string(regexp_extract_all(html, '<p[^>]*>([^<]*)</p>', 1), chr(10)) AS text FROM pages""")
def _(spark, sf_dir):
    return table(spark, sf_dir, "pages", ["page_id", "html"]).select("page_id", F.array_join(ordered.tags_of(F.col("html"), "p"), "\n").alias("text"))


_LINES = """lines AS (SELECT conv_id AS snapshot, turn // 3 AS page, turn AS position, coalesce(text, '') AS text FROM conversations),
placed AS (SELECT *, (sum(length(text) + 1) OVER (PARTITION BY snapshot ORDER BY page, position) - length(text) - 1)::BIGINT AS char_start FROM lines),
spans AS (SELECT *, char_start + length(text) AS char_end, (snapshot + position) % 17 <> 0 AS valid FROM placed)"""


def lines(spark, sf_dir):
    return table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"]).select(
        F.col("conv_id").alias("snapshot"), F.floor(F.col("turn") / 3).alias("page"), F.col("turn").alias("position"), F.coalesce("text", F.lit("")).alias("text")
    )


@query("canonical_offsets", f"WITH {_LINES} SELECT snapshot, page, position, text, char_start, char_end FROM spans")
def _(spark, sf_dir):
    return ordered.canonical_offsets(lines(spark, sf_dir))


@query(
    "range_line_overlap",
    f"""WITH {_LINES}, r AS (SELECT DISTINCT snapshot, k AS range_id, k * 150 AS start, k * 150 + 100 + k AS "end" FROM lines, (SELECT unnest(range(0, 8)) AS k)),
p AS (SELECT r.snapshot, range_id, page, position, char_start, char_end, valid FROM r JOIN spans s ON r.snapshot = s.snapshot AND char_start < r."end" AND char_end > r.start)
SELECT snapshot, range_id, page, position, char_start, char_end FROM p QUALIFY bool_and(valid) OVER (PARTITION BY snapshot, range_id)""",
)
def _(spark, sf_dir):
    placed = ordered.canonical_offsets(lines(spark, sf_dir)).withColumn("valid", (F.col("snapshot") + F.col("position")) % 17 != 0)
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("range_id")
    ranges = placed.select("snapshot").distinct().select("snapshot", k).withColumn("start", F.col("range_id") * 150).withColumn("end", F.col("range_id") * 151 + 100)
    return ordered.range_lines(ranges, placed)


@query(
    "line_correspondence",
    """WITH s AS (SELECT conv_id AS snapshot, turn // 3 AS page, turn AS position, CASE WHEN conv_id % 13 = 0 AND turn = 1 THEN NULL ELSE 'l' || turn END AS id FROM conversations),
t AS (SELECT conv_id AS snapshot, turn // 3 AS page, turn AS position, CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN 'x' ELSE 'l' || turn END AS id FROM conversations WHERE NOT (conv_id % 7 = 0 AND turn = 1)),
a AS (SELECT snapshot, page, count(*) AS n, count(DISTINCT id) AS d, count(*) - count(id) AS z, string_agg(coalesce(id, '?'), ',' ORDER BY position) AS ids FROM s GROUP BY ALL),
b AS (SELECT snapshot, page, count(*) AS n, count(DISTINCT id) AS d, count(*) - count(id) AS z, string_agg(coalesce(id, '?'), ',' ORDER BY position) AS ids FROM t GROUP BY ALL),
j AS (SELECT coalesce(a.snapshot, b.snapshot) AS snapshot, coalesce(a.z > 0, false) OR coalesce(b.z > 0, false) AS missing, coalesce(a.d < a.n, false) OR coalesce(b.d < b.n, false) AS doubled,
  a.n IS NULL OR b.n IS NULL AS pages, coalesce(a.n <> b.n, false) AS counts, coalesce(a.ids <> b.ids, false) AS ids FROM a FULL JOIN b ON a.snapshot = b.snapshot AND a.page = b.page)
SELECT snapshot, CASE WHEN bool_or(missing) THEN 'missing_line_id' WHEN bool_or(doubled) THEN 'duplicate_line_id' WHEN bool_or(pages) THEN 'page_structure' WHEN bool_or(counts) THEN 'page_count' WHEN bool_or(ids) THEN 'identity' END AS refusal
FROM j GROUP BY snapshot""",
)
def _(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", ["conv_id", "turn"])
    base = turns.select(F.col("conv_id").alias("snapshot"), F.floor(F.col("turn") / 3).alias("page"), F.col("turn").alias("position"), F.concat(F.lit("l"), F.col("turn").cast("string")).alias("line_id"))
    source = base.withColumn("line_id", F.when(~((F.col("snapshot") % 13 == 0) & (F.col("position") == 1)), F.col("line_id")))
    target = base.filter(~((F.col("snapshot") % 7 == 0) & (F.col("position") == 1))).withColumn("line_id", F.when((F.col("snapshot") % 5 == 0) & (F.col("position") == 0), "x").otherwise(F.col("line_id")))
    return ordered.correspondence(source, target)


@query(
    "bbox_percent",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS x0, l_partkey % 90 AS y0, l_quantity + 10 AS x1, l_partkey % 90 + l_suppkey % 20 AS y1 FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN y1 > y0 AND x1 <= 55 AND y1 <= 100 THEN round(100.0::DOUBLE * x0 / 55, 6) END AS "left", CASE WHEN y1 > y0 AND x1 <= 55 AND y1 <= 100 THEN round(100.0::DOUBLE * (y1 - y0) / 100, 6) END AS height FROM b""",
)
def _(spark, sf_dir):
    q, p, s = F.col("l_quantity"), F.col("l_partkey"), F.col("l_suppkey")
    box = ordered.box_percent(q, (p % 90).cast("double"), q + 10, (p % 90 + s % 20).cast("double"), F.lit(55.0), F.lit(100.0))
    rows = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_suppkey"]).withColumn("box", box)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "box.left", "box.height")


_WORDS = 'words AS (SELECT l_orderkey // 8 AS page, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS word, round(l_extendedprice / 100) AS ymin, round(l_extendedprice / 100) + l_quantity % 7 AS ymax FROM lineitem)'


def words(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"])
    y = F.round(F.col("l_extendedprice") / 100)
    return rows.select(F.floor(F.col("l_orderkey") / 8).alias("page"), F.xxhash64("*").alias("word"), y.alias("ymin"), (y + F.col("l_quantity") % 7).alias("ymax"))


@query(
    "line_clusters",
    f"""WITH {_WORDS}, s AS (SELECT *, (ymin > coalesce(max(ymax) OVER (PARTITION BY page ORDER BY ymin, ymax, word ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1))::INT AS new FROM words),
c AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY ymin, ymax, word ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cluster FROM s)
SELECT page, cluster::BIGINT AS cluster, min(ymin) AS ymin, max(ymax) AS ymax, count(*)::BIGINT AS words FROM c GROUP BY ALL""",
)
def _(spark, sf_dir):
    return ordered.line_clusters(words(spark, sf_dir))


@query("banding_plan")
def _(spark, sf_dir):
    return ordered.bands(ordered.line_clusters(words(spark, sf_dir)), 1100.0)


@query(
    "crop_merges",
    """WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents), u AS (SELECT doc_id, t[1:(len(t) + 1) // 2 + 1] AS a, t[(len(t) + 1) // 2:len(t)] AS b FROM s),
k AS (SELECT doc_id, a, b, (SELECT max(n) FROM unnest(range(0, least(len(a), len(b)) + 1)) x(n) WHERE (n = 0 OR a[len(a) - n + 1:len(a)] = b[1:n])) AS n FROM u)
SELECT doc_id, array_to_string(list_concat(a, b[n + 1:len(b)]), chr(10)) AS merged FROM k""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("t"))
    middle = F.floor((F.size("t") + 1) / 2).cast("int")
    halves = rows.select("doc_id", F.slice("t", F.lit(1), middle + 1).alias("a"), F.slice("t", middle, F.size("t")).alias("b"))
    return halves.select("doc_id", F.array_join(ordered.merge_overlap(F.col("a"), F.col("b")), "\n").alias("merged"))
