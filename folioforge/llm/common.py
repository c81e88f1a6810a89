"""Shared folder, stage tables and word rules used by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.sources.shared import shared_folder

#: A word is a run of anything but these six characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Texts that go to a Python worker at a time. Spark's default suits short rows; as many whole texts are many MB on both sides.
BATCH_ROWS = 512


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches at BATCH_ROWS rows at most; a smaller setting stays."""
    if not 0 < int(spark.conf.get(ARROW_ROWS)) <= BATCH_ROWS:
        spark.conf.set(ARROW_ROWS, BATCH_ROWS)


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/folioforge/{name}-{uuid.uuid4().hex}"


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to clash with no column of `df`."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def whole(df: DataFrame, *, without: tuple[str, ...] = ()) -> list[Column]:
    """All columns of `df` by name, whatever characters the names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in without]


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and go on from the files, which outlive any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Delete a stage table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def remove_stages(spark: SparkSession) -> None:
    """Delete all stage tables of the shared folder; to be called when no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/folioforge")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key alone: 52 bits of md5, which any SQL engine can repeat."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def read_columns(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*columns)
