"""Matches in texts, as searches show them."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.catalog.text import _LINES, lines
from folioforge.operators import access, matches, ordered, search
from folioforge.registry import query
from folioforge.sources.tables import table
from folioforge.sources.archive import ITEMS_SQL, items

WANTED = ["the", "and"]
_W = "[\\p{L}\\p{N}]"


def _windows(texts: str, name: str = "") -> str:
    """SQL of the best windows of a table (item_id, text), as tables p, h, w and b with a suffix."""
    return f"""p{name} AS (SELECT item_id, unnest(regexp_extract_all(text, '{_W}+|[^\\p{{L}}\\p{{N}}]+')) AS x, unnest(range(len(regexp_extract_all(text, '{_W}+|[^\\p{{L}}\\p{{N}}]+')))) AS k FROM {texts}),
e{name} AS (SELECT *, sum(length(x)) OVER (PARTITION BY item_id ORDER BY k) AS stop FROM p{name}),
h{name} AS (SELECT item_id, stop - length(x) AS start, stop, lower(x) AS term FROM e{name} WHERE lower(x) IN ('the', 'and')),
w{name} AS (SELECT a.item_id, a.start, count(DISTINCT b.term) AS n, max(b.stop) AS stop FROM h{name} a JOIN h{name} b ON a.item_id = b.item_id AND b.start >= a.start AND b.stop <= a.start + 220 GROUP BY ALL),
b{name} AS (SELECT item_id, n::BIGINT AS n_terms, start AS low, stop AS high FROM w{name} QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY n DESC, start) = 1)"""


_SNIPPETS = f"""WITH {ITEMS_SQL}, t AS (SELECT item_id, trim(regexp_replace(body, '[\\s\\x0b]+', ' ', 'g')) AS text FROM items WHERE visibility = 'PUBLIC'),
{_windows('t')},
s AS (SELECT t.*, n_terms, low, high, greatest(0, 190 - (high - low)) AS spare FROM t LEFT JOIN b USING (item_id)),
r AS (SELECT *, least(length(text) - high, spare - least(low, spare // 2)) AS more FROM s),
m AS (SELECT item_id, text, n_terms, low - least(low, spare - more) AS low, high + more AS high FROM r),
n AS (SELECT item_id, text, n_terms, coalesce(low - CASE WHEN regexp_matches(substr(text, (low + 1)::BIGINT), '^{_W}') THEN length(regexp_extract(left(text, low::BIGINT), '{_W}+$')) ELSE 0 END, 0) AS low,
  coalesce(high + CASE WHEN regexp_matches(left(text, high::BIGINT), '{_W}$') THEN length(regexp_extract(substr(text, (high + 1)::BIGINT), '^{_W}+')) ELSE 0 END, least(length(text), 190)) AS high FROM m),
shown AS (SELECT item_id, CASE WHEN low > 0 THEN '…' ELSE '' END || substr(text, (low + 1)::BIGINT, (high - low)::BIGINT) || CASE WHEN high < length(text) THEN '…' ELSE '' END AS snippet, coalesce(n_terms, 0) AS n_terms FROM n)"""


def _texts(spark, sf_dir):
    return access.visible(items(spark, sf_dir)).select("item_id", F.col("body").alias("text"))


@query("snippet_windows", f"{_SNIPPETS} SELECT item_id, snippet, n_terms FROM shown")
def _(spark, sf_dir):
    return matches.snippets(_texts(spark, sf_dir), WANTED)


@query(
    "snippet_segments",
    f"""{_SNIPPETS}, x AS (SELECT item_id, regexp_extract_all(snippet, '{_W}+|[^\\p{{L}}\\p{{N}}]+') AS parts FROM shown),
u AS (SELECT item_id, unnest(parts) AS part, unnest(range(len(parts))) AS k FROM x), f AS (SELECT *, lower(part) IN ('the', 'and') AS is_match FROM u),
g AS (SELECT *, (is_match OR coalesce(lag(is_match) OVER (PARTITION BY item_id ORDER BY k), true))::INT AS fresh FROM f),
q AS (SELECT *, sum(fresh) OVER (PARTITION BY item_id ORDER BY k) - 1 AS place FROM g)
SELECT item_id, place::INTEGER AS place, string_agg(part, '' ORDER BY k) AS part, bool_or(is_match) AS is_match FROM q GROUP BY item_id, place""",
)
def _(spark, sf_dir):
    return matches.segments(matches.snippets(_texts(spark, sf_dir), WANTED), WANTED)


@query(
    "match_presentation",
    f"""WITH {ITEMS_SQL}, t AS (SELECT item_id, body AS text FROM items), o AS (SELECT item_id - 1 AS item_id, body AS text FROM items WHERE item_id % 3 = 0),
{_windows('t')}, {_windows('o', '2')},
l AS (SELECT item_id, CASE WHEN contains(lower(author), 'src1') THEN 'author' WHEN contains(lower(title), 'src1') THEN 'title' ELSE 'none' END AS label FROM items)
SELECT l.item_id, CASE WHEN coalesce(b.n_terms, 0) > 0 AND b.n_terms >= coalesce(b2.n_terms, 0) THEN 'body' WHEN coalesce(b2.n_terms, 0) > 0 THEN 'translation' WHEN label = 'author' THEN 'metadata:author' END AS shown,
  greatest(coalesce(b.n_terms, 0), coalesce(b2.n_terms, 0))::BIGINT AS n_terms FROM l LEFT JOIN b USING (item_id) LEFT JOIN b2 USING (item_id)""",
)
def _(spark, sf_dir):
    rows = items(spark, sf_dir)
    body = rows.select("item_id", F.col("body").alias("text"))
    other = body.filter("item_id % 3 = 0").select((F.col("item_id") - 1).alias("item_id"), "text")
    label = F.when(F.contains(F.lower("author"), F.lit("src1")), "author").when(F.contains(F.lower("title"), F.lit("src1")), "title").otherwise("none")
    return matches.presentation(body, other, rows.select("item_id", label.alias("label")), WANTED)


_RANGES = """u AS (SELECT item_id, kind, term, unnest(string_split(lower(text), term)) AS x, unnest(range(len(string_split(lower(text), term)))) AS k, len(string_split(lower(text), term)) AS n FROM t, (SELECT unnest(['th', 'e a']) AS term) WHERE length(lower(text)) = length(text)),
f AS (SELECT *, sum(length(x)) OVER (PARTITION BY item_id, kind, term ORDER BY k) + k * length(term) AS start FROM u),
ranges AS (SELECT item_id, kind, term, start::BIGINT AS start, (start + length(term))::BIGINT AS "end" FROM f WHERE k < n - 1)"""


@query(
    "literal_match_ranges",
    f"""WITH {ITEMS_SQL}, t AS (SELECT item_id, 'body' AS kind, body AS text FROM items UNION ALL SELECT item_id, 'title', title FROM items), {_RANGES}
SELECT item_id, kind, term, start, "end" FROM ranges""",
)
def _(spark, sf_dir):
    rows = items(spark, sf_dir)
    both = rows.select("item_id", F.lit("body").alias("kind"), F.col("body").alias("text")).unionByName(rows.select("item_id", F.lit("title").alias("kind"), F.col("title").alias("text")))
    return matches.literal_ranges(both, ["item_id", "kind"], ["TH", "th", "e a"])


_GEOMETRY = f"""WITH {_LINES}, t AS (SELECT snapshot AS item_id, 0 AS kind, string_agg(text, chr(10) ORDER BY page, position) AS text FROM lines GROUP BY snapshot), {_RANGES},
r AS (SELECT item_id AS snapshot, start * 10 + length(term) AS range_id, start, "end" FROM ranges),
g AS (SELECT r.snapshot, range_id, page, position, char_start, char_end FROM r JOIN spans s ON r.snapshot = s.snapshot AND char_start < r."end" AND char_end > r.start QUALIFY bool_and(valid) OVER (PARTITION BY r.snapshot, range_id))"""


def _geometry(spark, sf_dir):
    placed = ordered.canonical_offsets(lines(spark, sf_dir)).withColumn("valid", (F.col("snapshot") + F.col("position")) % 17 != 0)
    whole = placed.groupBy(F.col("snapshot").alias("item_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "position", "text"))), lambda x: x["text"]), "\n").alias("text"))
    found = matches.literal_ranges(whole, ["item_id"], ["th", "e a"])
    ranges = found.select(F.col("item_id").alias("snapshot"), (F.col("start") * 10 + F.length("term")).alias("range_id"), "start", "end")
    return ordered.range_lines(ranges, placed)


@query("search_line_geometry", f"{_GEOMETRY} SELECT snapshot, range_id, page, position, char_start, char_end FROM g")
def _(spark, sf_dir):
    return _geometry(spark, sf_dir)


@query(
    "search_overlay_targets",
    f"""{_GEOMETRY}, b AS (SELECT snapshot || '/' || range_id AS match, page, position, (position * 40)::DOUBLE AS x0, (page * 30)::DOUBLE AS y0, (position * 40 + char_end - char_start)::DOUBLE AS x1, (page * 30 + 20)::DOUBLE AS y1 FROM g),
d AS (SELECT k::BIGINT AS page, 400.0::DOUBLE AS w, CASE WHEN k = 2 THEN 0.0 ELSE 500.0 END::DOUBLE AS h FROM range(0, 3) t(k)),
j AS (SELECT b.*, w, h, coalesce(w > 0 AND h > 0 AND x1 > x0 AND y1 > y0 AND x1 <= w AND y1 <= h, false) AS good FROM b LEFT JOIN d USING (page))
SELECT match, page, position, round(100.0::DOUBLE * x0 / w, 6) AS "left", round(100.0::DOUBLE * y0 / h, 6) AS top, round(100.0::DOUBLE * (x1 - x0) / w, 6) AS width, round(100.0::DOUBLE * (y1 - y0) / h, 6) AS height
FROM j QUALIFY bool_and(good) OVER (PARTITION BY match)""",
)
def _(spark, sf_dir):
    c = F.col
    rows = _geometry(spark, sf_dir).select(
        F.concat("snapshot", F.lit("/"), "range_id").alias("match"), "page", "position", (c("position") * 40).cast("double").alias("x0"), (c("page") * 30).cast("double").alias("y0"),
        (c("position") * 40 + c("char_end") - c("char_start")).cast("double").alias("x1"), (c("page") * 30 + 20).cast("double").alias("y1"),
    )
    pages = spark.range(3).select(c("id").alias("page"), F.lit(400.0).alias("page_width"), F.when(c("id") == 2, 0.0).otherwise(500.0).alias("page_height"))
    return matches.overlay(rows, pages)


@query(
    "index_refresh",
    f"""WITH {ITEMS_SQL}, f AS (SELECT item_id, list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS a,
  list_filter(regexp_split_to_array(lower(metadata), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS b, list_filter(regexp_split_to_array(lower(body), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS c FROM items WHERE item_id % 10 <> 5)
SELECT item_id, (len(list_distinct(a)) + len(list_distinct(b)) + len(list_distinct(c)))::BIGINT AS n FROM f WHERE item_id % 5 = 0 AND len(a) + len(b) + len(c) > 0
UNION ALL SELECT item_id, 1 FROM items WHERE item_id % 5 <> 0""",
)
def _(spark, sf_dir):
    rows = items(spark, sf_dir)
    stale = rows.select("item_id", F.lit("stale").alias("token"), F.lit("C").alias("field"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("first"))
    by_five = rows.filter("item_id % 5 = 0").select("item_id")
    asked = search.refresh_ids(by_five, by_five.filter("item_id % 2 = 0"), spark.range(1).select((F.col("id") - 7).alias("item_id")))
    return search.refreshed(stale, rows.filter("item_id % 10 <> 5"), asked).groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "token_spans",
    """WITH p AS (SELECT doc_id AS item_id, regexp_split_to_array(text, '[\\p{L}\\p{N}]+') AS gaps, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS hits FROM documents WHERE text IS NOT NULL),
u AS (SELECT item_id, unnest(hits) AS token, unnest(gaps[1:len(hits)]) AS gap, unnest(range(len(hits))) AS k FROM p),
s AS (SELECT item_id, token, sum(length(gap) + length(token)) OVER (PARTITION BY item_id ORDER BY k) AS stop FROM u)
SELECT item_id, (stop - length(token))::BIGINT AS start, stop::BIGINT AS "end", token FROM s""",
)
def _(spark, sf_dir):
    spans = matches.token_spans(table(spark, sf_dir, "documents", ["doc_id", "text"]).select(F.col("doc_id").alias("item_id"), "text"))
    return spans.select("item_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "token")
