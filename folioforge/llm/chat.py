"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and
all others as named users; spans mark the characters to learn, which are the assistant's turns with
their end marks. A conversation is rendered in parts of PART_TURNS turns by their place in it, so that a
very long one is many rows and never one group, whatever its turns' numbers are; the parts' texts in
order are the whole dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage_table

PART_TURNS = 512
END = "<|end|>\n"
UNKNOWN = "unknown"


def escaped(text: Column) -> Column:
    """A text in which no mark of the format can be read."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("<\\|"))


def placed(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text) with `place`, from 0, in the order of turn, role and the text's hash within the conversation.

    Rows are sorted in ranges, and a range's places go on from those before it: a conversation that fills
    many ranges, even with one row over and over, meets in no task.
    """
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("hash")]
    keyed = turns.withColumn("hash", F.md5(F.coalesce("text", F.lit("")).cast("binary"))).withColumn("tie", F.monotonically_increasing_id())
    ranges = keyed.repartitionByRange(*order, "tie").withColumn("range", F.spark_partition_id())
    ranges = stage_table(ranges.drop("tie"), "turn-ranges")
    sizes = ranges.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("conv_id", "range").orderBy(*order[1:])) - 1
    joined = ranges.withColumn("own", own).join(sizes, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")))
    return joined.select("conv_id", "turn", "role", "text", (F.col("before") + F.col("own")).alias("place"))


def rotate(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part_turns: int = PART_TURNS
) -> DataFrame:
    """A row for each conversation, perspective and part: n_turns, text, spans (array of start, end; in characters of `text`).

    Turns go by number, null first, then by role and the md5 of the text. A null role is the participant
    `unknown`, a null text the empty text; rows without a conversation id are one conversation. Repeated
    rows are turns of their own. Part p holds the `part_turns` turns from place p * part_turns on. Marks
    within texts are escaped. Empty table: no rows. Other columns are not read.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit(UNKNOWN)).alias("role"), F.col(text_col).cast("string").alias("text")
    )
    rows = placed(rows).withColumn("part", F.floor(F.col("place") / part_turns))
    turn = F.struct("place", "role", escaped(F.col("text")).alias("text"))
    parts = stage_table(rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns")), "turn-parts")
    speakers = parts.select(F.col("conv_id").alias("c"), F.explode(F.array_distinct("turns.role")).alias("perspective")).distinct()
    # small rows meet by conversation, and the turns' texts by part
    shown = parts.select("conv_id", "part").join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))).select("c", F.col("part").alias("p"), "perspective")
    paired = parts.join(shown, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")

    def render(t: Column) -> Column:
        own = t["role"] == F.col("perspective")
        head = F.when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), escaped(t["role"]), F.lit("|>\n")))
        return F.struct(own.alias("own"), head.alias("head"), F.concat(t["text"], F.lit(END)).alias("body"))

    blocks = paired.withColumn("blocks", F.transform("turns", render))
    span = lambda a, b: F.struct((a["at"] + F.length(b["head"])).alias("start"), (a["at"] + F.length(b["head"]) + F.length(b["body"])).alias("end"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    spans = F.aggregate(
        "blocks",
        F.struct(F.lit(0).alias("at"), none.alias("spans")),
        lambda a, b: F.struct(
            (a["at"] + F.length(b["head"]) + F.length(b["body"])).alias("at"), F.when(b["own"], F.array_append(a["spans"], span(a, b))).otherwise(a["spans"]).alias("spans")
        ),
        lambda a: a["spans"],
    )
    return blocks.select(
        "conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("blocks", lambda b: F.concat(b["head"], b["body"])), "").alias("text"), spans.alias("spans"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_columns

    made = rotate(read_columns(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    shown = F.array_join(F.transform("spans", lambda s: F.concat(s["start"], F.lit("-"), s["end"])), ",")
    return made.withColumn("spans", shown)


SQL = f"""
WITH o AS (SELECT conv_id, coalesce(role, '{UNKNOWN}') AS role, replace(coalesce(text, ''), '<|', '<\\|') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '{UNKNOWN}') COLLATE "C", md5(coalesce(text, ''))) - 1 AS place FROM conversations),
t AS (SELECT *, (place // {PART_TURNS})::BIGINT AS part FROM o),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t),
b AS (SELECT t.*, perspective, t.role = perspective AS own,
             CASE WHEN t.role = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || replace(t.role, '<|', '<\\|') || '|>' || chr(10) END AS head,
             t.text || '<|end|>' || chr(10) AS body
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (SELECT *, sum(length(head) + length(body)) OVER w - length(body) AS start, sum(length(head) + length(body)) OVER w AS stop,
             row_number() OVER w AS k
      FROM b WINDOW w AS (PARTITION BY conv_id, perspective, part ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT conv_id, perspective, part, count(*)::BIGINT AS n_turns, string_agg(head || body, '' ORDER BY k) AS text,
       coalesce(string_agg(start::BIGINT || '-' || stop::BIGINT, ',' ORDER BY k) FILTER (own), '') AS spans
FROM p GROUP BY conv_id, perspective, part
"""
