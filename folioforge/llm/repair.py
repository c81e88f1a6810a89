"""Repair of a conversation's roles by error-correcting Earley parsing.

The grammar of a whole conversation is (s?(ua)+)? over role initials, written left-linear: a state is what
has been derived so far. Its error productions have weights: a turn is kept, given another role or
deleted, and an empty turn is inserted. Chart items of a column hold the least (cost, audit) of their
state; the cheapest completed item of the last column is the repair.

A conversation is parsed in parts of PART_TURNS turns by place. A part's chart is filled once from every
state that may stand before it, so parts are parsed apart from each other; what leads from state to state
is then folded along the conversation, and each part is edited with its piece of the audit. No task holds
the turns of a conversation that is longer than a part.
"""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chat import PART_TURNS, placed
from .common import small_batches, stage_table

WORDY = "[^\\x20\\x09-\\x0D]"
#: Weights of the edits; an undeleted truncated turn costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: state -> {role initial: state after it}. A conversation may end in the states of DONE.
START, SYSTEM, USER, PAIR = range(4)
GRAMMAR = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": PAIR}, PAIR: {"u": USER}}
DONE = (START, PAIR)
#: Initials that an edit may give, and their roles.
GIVEN = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")

Item = tuple[int, str]


def _offer(column: dict[int, Item], state: int, item: Item) -> bool:
    if state not in column or item < column[state]:
        column[state] = item
        return True
    return False


def _predicted(column: dict[int, Item]) -> dict[int, Item]:
    """The column with all items that insertions lead to. An audit is never the beginning of an equally cheap one of the same state, so the order of items is that of what follows them."""
    agenda = list(column)
    while agenda:
        state = agenda.pop()
        cost, audit = column[state]
        for initial, after in GRAMMAR[state].items():
            if initial in GIVEN and _offer(column, after, (cost + INSERT, audit + "I")):
                agenda.append(after)
    return column


def parse(initials: list[str], faults: list[str], entry: int = START) -> dict[int, Item]:
    """state -> (cost, audit): the cheapest derivations of the turns from the state `entry`, ties to the least audit.

    faults: "blank" and "duplicate" turns must go, a "truncated" one costs more if it stays.
    """
    column = _predicted({entry: (0, "")})
    for initial, fault in zip(initials, faults, strict=True):
        scanned: dict[int, Item] = {}
        stays = fault not in ("blank", "duplicate")
        for state, (cost, audit) in column.items():
            _offer(scanned, state, (cost + DELETE, audit + "D"))
            if stays:
                cost += TRUNCATED * (fault == "truncated")
                for given, after in GRAMMAR[state].items():
                    if given == initial:
                        _offer(scanned, after, (cost, audit + "K"))
                    if given in GIVEN:
                        _offer(scanned, after, (cost + REROLE, audit + "R"))
        column = _predicted(scanned)
    return column


def edited(audit: str, entry: int, turns: list[tuple]) -> tuple[list[tuple], int]:
    """([(edit, role, text)], state after): what an audit makes of turns (role, text, …); a deleted turn has its own role and text."""
    out, state, at = [], entry, 0
    for edit in audit:
        role, text = (None, "") if edit == "I" else turns[at][:2]
        at += edit != "I"
        if edit != "D":
            if edit == "K":
                initial = role[:1]
            else:
                initial = next(x for x in GRAMMAR[state] if x in GIVEN)
                role = GIVEN[initial]
            state = GRAMMAR[state][initial]
        out.append((edit, role, text))
    return out, state


def _rows(batches, columns: list[str]):
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in columns), strict=True)


def _chart(batches):
    """(conv, part, initials, faults) -> (conv, part, illegal, first, last, entry, state, cost, audit): all cheapest ways through a part."""
    for batch in batches:
        out = []
        for conv, part, initials, faults in zip(batch["conv_id"], batch["part"].to_pylist(), batch["initials"].to_pylist(), batch["faults"].to_pylist(), strict=True):
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))  # noqa: B905
            for entry in GRAMMAR if part else (START,):
                out += [(conv, part, illegal, initials[0], initials[-1], entry, state, *item) for state, item in parse(initials, faults, entry).items()]
        if out:
            columns = list(zip(*out, strict=True))
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.string()]
            values = [pa.array([x.as_py() for x in columns[0]], kinds[0]), *(pa.array(c, k) for c, k in zip(columns[1:], kinds[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(values, names=CHART)


CHART = ["conv_id", "part", "illegal", "first", "last", "entry", "state", "cost", "audit"]


def _fold(kind: pa.DataType):
    """Rows of a chart by (conv, part) -> (conv, part, entry, piece, cost, illegal): the cheapest way through all parts of a conversation, and its piece of each."""

    def run(batches):
        for conv, rows in groupby(_rows(batches, CHART), key=lambda r: r[0]):
            best, back, illegal, before = {START: (0, "")}, [], 0, None
            for _, own in groupby(rows, key=lambda r: r[1]):
                after, came = {}, {}
                for k, (_, _, bad, first, last, entry, state, cost, audit) in enumerate(own):
                    illegal += (bad + (before is not None and before + first not in LEGAL)) if not k else 0
                    end = last
                    if entry in best and _offer(after, state, (best[entry][0] + cost, best[entry][1] + audit)):
                        came[state] = (entry, audit)
                best, before = after, end
                back.append(came)
            state = min((s for s in DONE if s in best), key=best.__getitem__)
            cost, pieces = best[state][0], []
            for came in reversed(back):
                state, audit = came[state]
                pieces.append((state, audit))
            for part, (entry, piece) in enumerate(reversed(pieces)):
                total = (cost, illegal) if not part else (0, 0)
                row = [pa.array([conv], kind), pa.array([part], pa.int64()), pa.array([entry], pa.int32()), pa.array([piece], pa.string()), pa.array([total[0]], pa.int64()), pa.array([total[1]], pa.int64())]
                yield pa.RecordBatch.from_arrays(row, names=["conv_id", "part", "entry", "piece", "cost", "illegal"])

    return run


def _merged(run, rows: int = 1024):
    """The batches of `run`, put together to some rows each."""

    def out(batches):
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return out


def _apply(kind: pa.DataType):
    """(conv, part, entry, piece, turns) -> (conv, part, step, edit, role, text)."""

    def run(batches):
        for batch in batches:
            for conv, part, entry, piece, turns in zip(*(batch[c].to_pylist() for c in ("conv_id", "part", "entry", "piece", "turns")), strict=True):
                steps = edited(piece, entry, [(t["role"], t["text"]) for t in turns])[0]
                edit, role, text = zip(*steps, strict=True)
                n = len(steps)
                columns = [pa.array([conv] * n, kind), pa.array([part] * n, pa.int64()), pa.array(range(n), pa.int64()), *(pa.array(c, pa.string()) for c in (edit, role, text))]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "step", "edit", "role", "text"])

    return run


def fault_of(text: Column, repeated: Column) -> Column:
    """A turn's first fault: blank, duplicate, truncated, or ok. repeated: role and text were seen earlier."""
    last = F.regexp_extract(text, f"({WORDY})[\\x20\\x09-\\x0D]*\\z", 1)
    return F.when(~text.rlike(WORDY), "blank").when(repeated, "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("ok")


def marked(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text, without nulls in the last two) with place, part and fault."""
    rows = stage_table(placed(turns).withColumn("text_hash", F.md5("text")), "turns-in-order")
    same = ["conv_id", "role", "text_hash"]
    seen = rows.groupBy(*same).agg(F.min("place").alias("earliest"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    seen = seen.select(*[F.col(c).alias(f"{c}_0") for c in same], "earliest")
    joined = rows.join(seen, [F.col(c).eqNullSafe(F.col(f"{c}_0")) for c in same], "left")
    fault = fault_of(F.col("text"), F.coalesce(F.col("place") > F.col("earliest"), F.lit(False)))
    return joined.select("conv_id", "turn", "role", "text", "place", F.floor(F.col("place") / PART_TURNS).alias("part"), fault.alias("fault"))


def repaired(
    turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(report, edits) of conversations.

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. edits: conv_id, part, step, edit
    (K, R, D or I), role, text, in the order of part and step; rows of all edits but D are the repaired
    conversation.

    Turns go by number, null first, then by role and the md5 of the text. A null role or text counts as one
    space; an initial outside the grammar, or an empty role, cannot be kept. Rows without a conversation id
    are one conversation. Repeated rows are turns of their own, of which all but the first are duplicates.
    Turns that lack a number have no part in `gaps`. Of equally cheap repairs that of the least audit, by
    code point, is chosen. Empty table: no rows. Other columns are not read.
    """
    spark = turns.sparkSession
    small_batches(spark)
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = marked(turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text")))
    rows = stage_table(rows, "turns-marked")
    turn = F.struct("place", "role", "text", "fault")
    parts = stage_table(rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(turn)).alias("turns")), "turn-parts")  # PART_TURNS at most
    conv = parts.schema["conv_id"].dataType.simpleString()
    kind = parts.limit(0).select("conv_id").toArrow().schema.field("conv_id").type
    lean = parts.select("conv_id", "part", F.transform("turns", lambda t: F.left(t["role"], F.lit(1))).alias("initials"), F.transform("turns", lambda t: t["fault"]).alias("faults"))
    chart = lean.mapInArrow(_chart, f"conv_id {conv}, part long, illegal long, first string, last string, entry int, state int, cost long, audit string")
    dealt = chart.repartition("conv_id").sortWithinPartitions("conv_id", "part", "entry", "state")
    pieces = stage_table(dealt.mapInArrow(_merged(_fold(kind)), f"conv_id {conv}, part long, entry int, piece string, cost long, illegal long"), "audit-pieces")
    mine = pieces.select(F.col("conv_id").alias("conv_0"), F.col("part").alias("part_0"), "entry", "piece")
    edits = parts.join(mine, F.col("conv_id").eqNullSafe(F.col("conv_0")) & (F.col("part") == F.col("part_0"))).select("conv_id", "part", "entry", "piece", "turns")
    edits = edits.mapInArrow(_merged(_apply(kind)), f"conv_id {conv}, part long, step long, edit string, role string, text string")

    turn_numbers = rows.filter("turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n"))
    spread = turn_numbers.groupBy(F.col("conv_id").alias("conv_0")).agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps"))
    counts = rows.groupBy("conv_id").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    audits = pieces.groupBy(F.col("conv_id").alias("conv_1")).agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "piece"))), lambda x: x["piece"]), "").alias("audit")
    )
    report = counts.join(spread, F.col("conv_id").eqNullSafe(F.col("conv_0")), "left").join(audits, F.col("conv_id").eqNullSafe(F.col("conv_1")))
    return report.select("conv_id", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit"), edits


def _hashed(kind: pa.DataType):
    """Rows of edits by conversation, in order -> (conv, repaired_sha256), one text at a time."""

    def run(batches):
        for conv, rows in groupby(_rows(batches, ["conv_id", "role", "text"]), key=lambda r: r[0]):
            digest, gap = hashlib.sha256(), b""
            for _, role, text in rows:
                digest.update(gap + f"{role}:{text}".encode())
                gap = b"\n"
            yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return run


def digests(edits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the conversations of which something is left: SHA-256 of the lines `role:text`."""
    conv = edits.schema["conv_id"].dataType.simpleString()
    kind = edits.sparkSession.createDataFrame([], f"x {conv}").toArrow().schema.field("x").type
    left = edits.filter("edit <> 'D'").repartition("conv_id").sortWithinPartitions("conv_id", "part", "step")
    return left.mapInArrow(_merged(_hashed(kind)), f"conv_id {conv}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """`turns` (conv_id, turn, role, text) with one of five faults put on a quarter of the rows; nulls count as one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    rows = turns.withColumn("fate", F.crc32(key) % 20).filter("fate <> 0")
    fate = F.col("fate")
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = rows.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(role).alias("role"), text.alias("text"), "fate")
    return rows.withColumn("copy", F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "fate")


def damaged_and_repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, damaged first.

    A conversation of which no row is left has zeros, the empty audit and the hash of the empty text.
    """
    report, edits = repaired(damaged(turns))
    base = turns.select(F.col("conv_id").alias("own")).distinct()
    hashes = digests(edits).withColumnRenamed("conv_id", "hashed")
    rows = base.join(report, F.col("own").eqNullSafe(F.col("conv_id")), "left").join(hashes, F.col("own").eqNullSafe(F.col("hashed")), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("own").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_columns

    return damaged_and_repaired(read_columns(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
