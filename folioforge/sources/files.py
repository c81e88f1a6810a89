"""File sources and sinks: object listings, page XML, spreadsheets, checked CSV, reports, snapshots."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEPARATOR = "\n"


def listing(spark: SparkSession, path: str) -> DataFrame:
    """(key, modified, size) of the files below a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("key"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


LINES = "page long, position int, line_id string, text string, points string, char_start long, char_end long"


def page_xml_lines(pages: DataFrame) -> DataFrame:
    """Text lines of page XML (page, xml): document order, offsets in the page's text, polygon points; lines without text are skipped.

    Elements count by local name, with or without a namespace; XML that cannot be read gives no lines.
    """

    def parse(frames):
        for frame in frames:
            rows = []
            for page, xml in zip(frame["page"], frame["xml"], strict=True):
                try:
                    root = ElementTree.fromstring(xml or "")
                except ElementTree.ParseError:
                    continue
                at, position = 0, 0
                for line in (e for e in root.iter() if _local(e) == "TextLine"):
                    text = next((u.text or "" for t in line if _local(t) == "TextEquiv" for u in t if _local(u) == "Unicode"), "")
                    if not text.strip():
                        continue
                    points = next((c.get("points") for c in line if _local(c) == "Coords"), None)
                    rows.append((page, position, line.get("id"), text, points, at, at + len(text)))
                    at, position = at + len(text) + len(SEPARATOR), position + 1
            yield pd.DataFrame(rows, columns=["page", "position", "line_id", "text", "points", "char_start", "char_end"])

    return pages.select("page", "xml").mapInPandas(parse, LINES)


def _local(element) -> str:
    return element.tag.rpartition("}")[2]


def sheet(spark: SparkSession, path: str, name: str, required: tuple[str, ...] = ()) -> DataFrame:
    """A sheet of an XLSX workbook as strings, its first row the column names, or the first that has all `required` ones; blank rows are dropped.

    The workbook is read as one binary row, through whatever store Spark reads, and unzipped in the task.
    """
    book = spark.read.format("binaryFile").load(path).select("content")

    def header(frames):
        for frame in frames:
            for content in frame["content"]:
                found = next((r for _, r in _from_header(bytes(content), name, required)), []) if name in _sheets_of(bytes(content)) else None
                yield pd.DataFrame({"names": [found]})

    columns = book.mapInPandas(header, "names array<string>").first()["names"]  # only the names leave the task
    if columns is None:
        raise ValueError(f"no sheet {name}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def read(frames):
        for frame in frames:
            for content in frame["content"]:
                rows = [r for k, r in _from_header(bytes(content), name, required) if k]
                rows = [(r + [None] * len(columns))[: len(columns)] for r in rows if any(x not in (None, "") for x in r)]
                yield pd.DataFrame(rows, columns=columns, dtype=object)

    return book.mapInPandas(read, schema)


def _from_header(content: bytes, name: str, required: tuple[str, ...]):
    """(number, row) from the header row on, which is number 0."""
    number = -1
    for row in _rows_of(content, name):
        if number >= 0 or set(required) <= set(row):
            number += 1
            yield number, row


def open_reviews(aliases: DataFrame, status: str = "status", key: str = "id", closed: tuple[str, ...] = ("APPROVED", "REJECTED")) -> DataFrame:
    """Ids of a sheet's alias rows whose review is not closed, each once."""
    return aliases.filter(~F.coalesce(F.upper(F.trim(status)).isin(*closed), F.lit(False))).select(key).distinct()


def checked_json(spark: SparkSession, path: str, schema: str, expected_sha256: str) -> DataFrame:
    """A JSON file of one array or object of a fixed schema; a file whose hash is not the expected one fails the read, and so does what does not fit."""
    _same_hash(spark, path, expected_sha256)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _same_hash(spark: SparkSession, path: str, expected: str) -> None:
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if found != expected:
        raise ValueError(f"the file's SHA-256 is {found}")


def _sheets_of(content: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return [e.get("name") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e) == "sheet"]


def _rows_of(content: bytes, name: str):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        texts = []
        if "xl/sharedStrings.xml" in z.namelist():
            texts = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si) == "si"]
        at = _sheets_of(content).index(name) + 1
        for row in (e for e in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{at}.xml")).iter() if _local(e) == "row"):
            cells: list[str | None] = []
            for cell in row:
                letters = re.match("[A-Z]+", cell.get("r") or "")
                place = len(cells)
                if letters:
                    place = 0
                    for ch in letters[0]:
                        place = place * 26 + ord(ch) - 64
                    place -= 1
                cells += [None] * (place + 1 - len(cells))
                value = next((e.text for e in cell.iter() if _local(e) in ("v", "t")), None)
                cells[place] = texts[int(value)] if cell.get("t") == "s" and value is not None else value
            yield cells


def checked_csv(spark: SparkSession, path: str, schema: str, expected_sha256: str | None = None) -> DataFrame:
    """A CSV of a fixed schema; a malformed row fails the read, and so does a file whose hash is not the expected one."""
    if expected_sha256:
        _same_hash(spark, path, expected_sha256)
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def write_reports(rows: DataFrame, destination: str, summary: dict[str, int]) -> None:
    """Rows as CSV and JSON, and a summary as a Markdown table, each a folder of its own."""
    rows.write.mode("overwrite").option("header", True).csv(f"{destination}/csv")
    rows.write.mode("overwrite").json(f"{destination}/json")
    lines = ["| Name | Count |", "| --- | --- |", *[f"| {k} | {v} |" for k, v in summary.items()]]
    rows.sparkSession.createDataFrame([("\n".join(lines),)], "value string").write.mode("overwrite").text(f"{destination}/markdown")


def append_snapshots(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of `new` to append to content-addressed snapshots: one for each key that is not there yet."""
    return new.join(existing.select(*key), key, "left_anti").dropDuplicates(key)


def events_of(before: DataFrame, after: DataFrame, key: str, action: str) -> DataFrame:
    """Append-only log rows (key, action, before, after as JSON) of all rows that an action changed."""
    a = before.select(key, F.to_json(F.struct(*[c for c in before.columns if c != key])).alias("before"))
    b = after.select(key, F.to_json(F.struct(*[c for c in after.columns if c != key])).alias("after"))
    changed = a.join(b, key, "full").filter(~F.col("before").eqNullSafe(F.col("after")))
    return changed.select(key, F.lit(action).alias("action"), "before", "after")


def revise(history: DataFrame, edits: DataFrame) -> DataFrame:
    """History rows (result_id, revision, text) that edits (result_id, base_revision, text) add; an edit of an old revision is dropped, of several for one result the least text wins."""
    now = history.groupBy("result_id").agg(F.max(F.struct("revision", "text")).alias("now"))
    one = edits.groupBy("result_id", "base_revision").agg(F.min("text").alias("text"))
    joined = one.join(now, "result_id").filter((F.col("base_revision") == F.col("now.revision")) & (F.col("text") != F.col("now.text")))
    return joined.select("result_id", (F.col("base_revision") + 1).alias("revision"), "text")


def page_rows(files: DataFrame) -> DataFrame:
    """(document_id, file_id, page): a document's files (document_id, file_id, position) in order, pages from 1."""
    from pyspark.sql import Window

    order = Window.partitionBy("document_id").orderBy("position", "file_id")
    return files.select("document_id", "file_id", F.row_number().over(order).alias("page"))


def keys_of(rows: DataFrame, *columns: str) -> DataFrame:
    """(key): the object keys that any of the columns holds, trimmed, each once; blanks are none."""
    keys = rows.select(F.explode(F.array(*[F.trim(c) for c in columns])).alias("key"))
    return keys.filter(F.length("key") > 0).distinct()
