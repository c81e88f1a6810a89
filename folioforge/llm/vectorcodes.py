"""Vector codes by product quantisation: k-means over parts of integer vectors, in an RDD's reduction tree.

Vectors are packed once into blocks of columns, [part, dimension, row], written to the shared folder. A
round maps each block to tensors of sums and counts, [part, entry, dimension] and [part, entry]: squared
distances accumulate dimension by dimension, `np.add.at` adds the rows to their nearest entries, and
`treeAggregate` merges the tensors of all blocks. Only these tensors, of a size that the number of rows
does not change, come to the driver, which divides them. A last pass writes codes and errors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage_table
from .topk import integer_vector

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096.0
#: Bytes of a block at 8 a component; a vector that is longer is a block of its own.
BLOCK_BYTES = 1 << 21
#: A label of more than this share of all rows is hot: so many labels at most are broadcast.
HOT_SHARE, HOT_ROWS = 1e-4, 256
_FITS = 1 << 62
_TOP = (1 << 63) - 1


def _pack(width: int, stored: str, out):
    """(id, label, v) -> (ids, labels, n, data): blocks of columns; what a shorter vector lacks is zero."""
    most = max(1, BLOCK_BYTES // (8 * max(1, width)))

    def block(ids, labels, vectors):
        data = np.zeros((width, len(vectors)), np.dtype(stored))
        for i, v in enumerate(vectors):
            data[: len(v), i] = v
        columns = [[ids], [labels], [len(vectors)], [data.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, out, strict=True)], names=["ids", "labels", "n", "data"])

    def run(batches):
        ids, labels, vectors = [], [], []
        for batch in batches:
            lists = batch["v"]
            flat, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for i, (own, label) in enumerate(zip(batch["id"].to_pylist(), batch["label"].to_pylist(), strict=True)):
                ids.append(own)
                labels.append(label)
                vectors.append(flat[at[i] : at[i + 1]])
                if len(ids) == most:
                    yield block(ids, labels, vectors)
                    ids, labels, vectors = [], [], []
        if ids:
            yield block(ids, labels, vectors)

    return run


def _integers(x: np.ndarray, kind) -> np.ndarray:
    return x.astype(np.int64) if kind is np.int64 else np.array([int(v) for v in x.ravel()], dtype=object).reshape(x.shape)


def _columns(data: bytes, n: int, stored: str, parts: int, kind) -> np.ndarray:
    """A block as [part, dimension, row]."""
    flat = np.frombuffer(data, np.dtype(stored))
    return _integers(flat, kind).reshape(parts, flat.size // (parts * n), n)


def nearest(columns: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes [part, row], squared distances [part, row]) of columns [part, dimension, row] and books [part, entry, dimension]; ties to the lower index."""
    parts, width, n = columns.shape
    codes, errors = np.zeros((parts, n), np.int64), np.zeros((parts, n), columns.dtype)
    for p in range(parts):
        distance = np.zeros((books.shape[1], n), columns.dtype)
        for d in range(width):
            apart = columns[p, d] - books[p, :, d, None]
            distance += apart * apart
        codes[p] = distance.argmin(axis=0)
        errors[p] = distance[codes[p], np.arange(n)]
    return codes, errors


def _tally(books: np.ndarray, stored: str, kind):
    """Adds a block's rows to the (sums, counts) of their nearest entries."""

    def run(found, row):
        columns = _columns(row[1], row[0], stored, len(books), kind)
        sums, counts = found or (np.zeros(books.shape, books.dtype), np.zeros(books.shape[:2], np.int64))
        codes, _ = nearest(columns, books)
        for p in range(len(books)):
            np.add.at(counts[p], codes[p], 1)
            for d in range(books.shape[2]):
                np.add.at(sums[p, :, d], codes[p], columns[p, d])
        return sums, counts

    return run


def _merged(a, b):
    return a if b is None else b if a is None else (a[0] + b[0], a[1] + b[1])


def _encode(books: np.ndarray, stored: str, kind, out):
    def run(batches):
        for batch in batches:
            for ids, labels, n, data in zip(*(batch[c].to_pylist() for c in ("ids", "labels", "n", "data")), strict=True):
                codes, errors = nearest(_columns(data, n, stored, len(books), kind), books)
                code = ["".join(f"{c:02x}" for c in row) for row in codes.T.tolist()]
                error = [min(int(e), _TOP) for e in errors.sum(axis=0)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, labels, code, error), out, strict=True)], names=["vec_id", "label", "code", "error"])

    return run


def trained(blocks: DataFrame, books: np.ndarray, *, stored: str, rounds: int = ROUNDS, depth: int = 2) -> np.ndarray:
    """The books [part, entry, dimension] after so many rounds over `blocks`; entries that no row is nearest to stay."""
    kind = np.int64 if books.dtype == np.int64 else object
    for _ in range(rounds):
        found = blocks.select("n", "data").rdd.map(tuple).treeAggregate(None, _tally(books, stored, kind), _merged, depth)
        if found is None:
            break
        sums, counts = found
        used = counts > 0
        books = books.copy()
        books[used] = sums[used] // counts[used][:, None]
    return books


def vector_codes(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector; see `encoded` for its books.

    Components become floor(scale * x). A vector is cut into `parts` equal parts; each part has a book of
    `entries` entries, which begin as the parts of the rows of the least ids. A row whose vector is null or
    holds a null or non-finite component takes no part. Vectors of different lengths, or of one that the
    parts do not divide, count as filled up with zeros to the least length that they do. A null id comes
    after all others, and among equal ids the smaller vector first; each repeated row has its row. Fewer
    rows than `entries`: so many entries. Sums and distances are exact at any size; an error beyond the
    range of long is shown as its end. Empty table, or no vector kept: no rows. Other columns are not read.
    """
    coded, digest = encoded(vectors, id_col=id_col, vector_col=vector_col, label_col=label_col, parts=parts, entries=entries, rounds=rounds, scale=scale)[:2]
    return coded.withColumn("codebooks_sha256", F.lit(digest)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def encoded(vectors: DataFrame, *, id_col: str, vector_col: str, label_col: str, parts: int, entries: int, rounds: int, scale: float) -> tuple[DataFrame, str, np.ndarray]:
    """((vec_id, label, code, error, label_error), SHA-256 of the books, the books [part, entry, dimension])."""
    small_batches(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), integer_vector(F.col(vector_col), scale).alias("v")).filter("v IS NOT NULL")
    id_type, label_type = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    largest = F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))
    n, longest, top = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), largest).first()
    width, top = parts * -(-(longest or 0) // parts), int(top or 0)
    kind = np.int64 if max(4 * top * top * max(1, width), top * n) < _FITS else object
    stored = "int16" if top < 1 << 15 else "int32" if top < 1 << 31 else "float64"
    seeds = [r.v for r in rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()]  # `entries` rows
    padded = np.array([[int(x) for x in v] + [0] * (width - len(v)) for v in seeds], dtype=kind).reshape(len(seeds), parts, width // parts)
    arrow = rows.limit(0).select("id", "label").toArrow().schema
    types = [pa.list_(arrow.field("id").type), pa.list_(arrow.field("label").type), pa.int32(), pa.binary()]
    blocks = rows.mapInArrow(_pack(width, stored, types), f"ids array<{id_type}>, labels array<{label_type}>, n int, data binary")
    blocks = stage_table(blocks, "vector-blocks")
    books = trained(blocks, padded.transpose(1, 0, 2).copy(), stored=stored, rounds=rounds)
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    out = [arrow.field("id").type, arrow.field("label").type, pa.string(), pa.int64()]
    coded = stage_table(blocks.mapInArrow(_encode(books, stored, kind, out), f"vec_id {id_type}, label {label_type}, code string, error long"), "vector-codes")
    return _with_label_errors(coded, n), digest, books


def _with_label_errors(coded: DataFrame, n: int) -> DataFrame:
    """`coded` with the sum of the errors of each row's label; rows of a hot label do not meet in one task."""
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_TOP).cast("decimal(38,0)")).cast("long")
    totals = stage_table(coded.groupBy("label").agg(total.alias("label_error"), F.count(F.lit(1)).alias("rows")).withColumnRenamed("label", "own"), "label-errors")
    is_hot = F.col("rows") > max(HOT_ROWS, int(HOT_SHARE * n))
    same = F.col("label").eqNullSafe(F.col("own"))
    hot = F.broadcast(totals.filter(is_hot))  # 1 / HOT_SHARE rows at most
    names = ["vec_id", "label", "code", "error", "label_error"]
    rest = coded.join(hot, same, "left_anti").join(totals.filter(~is_hot), same)
    return coded.join(hot, same).select(*names).unionByName(rest.select(*names))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_columns

    return vector_codes(read_columns(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """Rounds as a chain of tables: b<r> the books, a<r> the nearest entry of each part."""
    made = [f"""
v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE}::DOUBLE * x::DOUBLE)::BIGINT) AS c, row_number() OVER (ORDER BY vec_id, embedding) AS own
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT own, part, c[part * len(c) // {parts} + 1:(part + 1) * len(c) // {parts}] AS x FROM v, (SELECT unnest(range({parts})) AS part)),
b0 AS MATERIALIZED (SELECT part, own - 1 AS entry, x AS y FROM p WHERE own <= {entries})"""]
    for r in range(rounds + 1):
        made.append(f"""a{r} AS MATERIALIZED (SELECT own, p.part, any_value(x) AS x, min(struct_pack(d := list_sum(list_transform(list_zip(x, y), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, entry := entry)) AS best
  FROM p JOIN b{r} b ON b.part = p.part GROUP BY own, p.part)""")
        if r < rounds:
            made.append(f"""m{r} AS MATERIALIZED (SELECT part, best.entry AS entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY ALL),
b{r + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(z.y, b.y) AS y FROM b{r} b LEFT JOIN
  (SELECT part, entry, list((s - (s % n + n) % n) // n ORDER BY i) AS y FROM m{r} GROUP BY ALL) z ON z.part = b.part AND z.entry = b.entry)""")
    return "WITH " + ",\n".join(made) + f""",
h AS (SELECT sha256(string_agg(y::VARCHAR, ',' ORDER BY part, entry, i)) AS codebooks_sha256 FROM (SELECT part, entry, unnest(y) AS y, generate_subscripts(y, 1) AS i FROM b{rounds})),
e AS (SELECT own, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY own)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e JOIN v USING (own), h
"""


SQL = _sql()
