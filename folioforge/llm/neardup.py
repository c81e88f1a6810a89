"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

Documents with one and the same shingle set are one node. Nodes that share a band key are candidates:
first every member of a bucket is verified against the bucket's least node; then, in the buckets that
still hold nodes of several components, all pairs across components whose signatures agree well enough
are verified, and only links that join components leave the task. Large buckets are dealt in pairs of
blocks, first of signatures alone; texts go only to the pairs of blocks, and of those only to the nodes,
whose signatures agree. Every link is verified on the full sets of both texts.

With 48 bands of 5 coordinates, two sets of similarity 0.75 share no band with probability 2e-6.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage_table, unused, whole
from .components import connected_components
from .shingles import Circulant, band_keys, shingle_set, similar

BANDS, ROWS = 48, 5
PERCENT = 75
#: Coordinates of two signatures that agree by chance or not: below this share a pair is not verified (0.75 is 7 deviations above).
AGREE = 0.55
#: Nodes of a block of a large bucket, and members verified in a row against one pivot.
BLOCK = 512
STAR_BLOCK = 128
#: Node ids that are broadcast to filter the texts; beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000

_maker: dict[int, Circulant] = {}


def _signature(shingles: np.ndarray) -> np.ndarray:
    if BANDS * ROWS not in _maker:
        _maker[BANDS * ROWS] = Circulant(BANDS * ROWS)
    return _maker[BANDS * ROWS].signature(shingles)


def _digests(shingles: np.ndarray, seed: int) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    a, b = xxhash.xxh3_128_intdigest(shingles.tobytes(), seed=seed).to_bytes(16, "big")[:8], xxhash.xxh64_digest(shingles.tobytes(), seed=seed)
    return int.from_bytes(a, "big", signed=True), int.from_bytes(b, "big", signed=True)


def _profile(seed: int):
    """(id, text) -> (id, n, node, check, bands)."""

    def run(batches):
        for batch in batches:
            n, node, check, bands = [], [], [], []
            for text in batch["text"].to_pylist():
                s = shingle_set(text)
                n.append(len(s))
                a, b = _digests(s, seed) if len(s) else (None, None)
                node.append(a)
                check.append(b)
                bands.append(band_keys(_signature(s), BANDS, ROWS) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["id", "n", "node", "check", "bands"],
            )

    return run


def _payload(seed: int):
    """text -> (node, text, bands, low byte of each coordinate)."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch["text"].to_pylist():
                s = shingle_set(text)
                if len(s):
                    g = _signature(s)
                    rows.append((_digests(s, seed)[0], text, band_keys(g, BANDS, ROWS).tobytes(), (g & 255).astype(np.uint8).tobytes()))
            if rows:
                node, text, bands, sig = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), pa.array(text, pa.string()), pa.array(bands, pa.binary()), pa.array(sig, pa.binary())],
                    names=["node", "text", "bands", "sig"],
                )

    return run


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _rows(batches, columns: list[str]):
    for batch in batches:
        yield from zip(*(batch[c].to_pylist() for c in columns), strict=True)


def _verify_stars(batches):
    """Rows by (pivot, block), the pivot's own first: links of members that are similar to the pivot."""
    out, at, own = [], None, None
    for pivot, block, member, node, text in _rows(batches, ["pivot", "block", "member", "node", "text"]):
        if not member:
            at, own = (pivot, block), shingle_set(text)
        elif (pivot, block) == at and similar(shingle_set(text), own, PERCENT):
            out.append((node, pivot))
        if len(out) >= 10_000:
            yield _links(out)
            out = []
    yield _links(out)


class _Union(dict):
    def find(self, x):
        while (p := self.get(x, x)) != x:
            self[x] = self.get(p, p)
            x = p
        return x

    def join(self, a, b) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self[max(a, b)] = min(a, b)


def _close(r: tuple, key: int, component: np.ndarray, bands: np.ndarray, sig: np.ndarray, agree: np.ndarray) -> np.ndarray:
    """The rows whose signatures agree with r's, of other components, and share no band with it before this bucket's."""
    close = np.flatnonzero((agree >= AGREE * BANDS * ROWS) & (component != r[2]))
    if not len(close):
        return close
    mine = np.frombuffer(r[3], np.int64)
    band = int(np.flatnonzero(mine == key)[0])
    return close[~(bands[close, :band] == mine[:band]).any(axis=1)]


def _halves(rows: list[tuple], across: bool) -> tuple[list[tuple], list[tuple]]:
    """The rows that are compared with each other; within one block the same ones twice."""
    if not across:
        return rows, rows
    return [r for r in rows if r[0] == rows[0][0]], [r for r in rows if r[0] != rows[0][0]]


def _pairs(key: int, left: list[tuple], right: list[tuple], across: bool):
    """(row of left, places in right that it is to be compared with, best first)."""
    if not right:
        return
    bands = np.array([np.frombuffer(r[3], np.int64) for r in right])
    sig = np.array([np.frombuffer(r[4], np.uint8) for r in right])
    component = np.array([r[2] for r in right])
    for i, r in enumerate(left):
        last = len(right) if across else i
        agree = (sig[:last] == np.frombuffer(r[4], np.uint8)).sum(axis=1)
        close = _close(r, key, component[:last], bands[:last], sig[:last], agree)
        if len(close):
            yield r, close[np.argsort(-agree[close], kind="stable")]


def promising(key: int, rows: list[tuple], across: bool) -> list[tuple[int, int]]:
    """(block, node) of the rows that are to be compared with any other. rows: (block, node, component, bands, sig)."""
    left, right = _halves(rows, across)
    found = set()
    for r, close in _pairs(key, left, right, across):
        found.add(r[:2])
        found.update(right[j][:2] for j in close)
    return sorted(found)


def verify_bucket(key: int, rows: list[tuple], across: bool) -> list[tuple[int, int]]:
    """Links that join components of one bucket, or of two blocks of it if `across`.

    rows: (block, node, component, bands, sig, text). A pair belongs to the first band that its nodes share.
    """
    left, right = _halves(rows, across)
    sets: dict[int, np.ndarray] = {}
    known, links = _Union(), []

    def of(r):
        if r[1] not in sets:
            sets[r[1]] = shingle_set(r[5])
        return sets[r[1]]

    for r, close in _pairs(key, left, right, across):
        for j in close:
            other = right[j]
            if known.find(r[2]) != known.find(other[2]) and similar(of(r), of(other), PERCENT):
                known.join(r[2], other[2])
                links.append((r[1], other[1]))
    return links


_CELL = ["key", "i", "j", "block", "node", "component", "bands", "sig"]


def _promising_cells(batches):
    for (key, i, j), rows in groupby(_rows(batches, _CELL), key=lambda r: r[:3]):
        if found := promising(key, [r[3:] for r in rows], i != j):
            block, node = zip(*found, strict=True)
            yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in zip(_CELL, ([key] * len(found), [i] * len(found), [j] * len(found), block, node))})


def _verify_blocks(batches):
    for (key, i, j), rows in groupby(_rows(batches, [*_CELL, "text"]), key=lambda r: r[:3]):
        if links := verify_bucket(key, [r[3:] for r in rows], i != j):
            yield _links(links)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id, kept. Ids may be of any type that has an order.

    Shingles are the distinct runs of five words, A-Z lower-cased; a shorter text is one shingle. Documents
    are linked at a Jaccard similarity of 0.75 or more; component_id is the least id that links reach,
    kept says that it is the document's own.

    Null, empty or blank text: no shingle, its own component, kept. Null id: takes part in links; its
    component_id is the least id of the component, and where that has no id at all, the rows of one of its
    texts are kept. Repeated rows of an id: each has its row; their texts are nodes of their own, which the id does
    not link. Empty table: empty result. Other columns are not read. Results are the same for any order
    and partitioning of the rows.
    """
    return _labelled(docs, id_col, text_col)[0].drop("node")


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The result of `near_duplicates` with the node of each row, and the seed of the nodes' hashes."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    for seed in range(8):
        facts = stage_table(rows.mapInArrow(_profile(seed), f"id {kind}, n long, node long, check long, bands array<long>"), "profile")
        nodes = stage_table(
            facts.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("low"), (F.min("check") != F.max("check")).alias("clash")), "nodes"
        )
        if not nodes.filter("clash").limit(1).count():
            break  # else two sets have one hash: hash anew
    else:
        raise RuntimeError("different sets keep the same 64-bit hash")

    banded = facts.filter("node IS NOT NULL").select("node", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("most")).filter("pivot <> most").drop("most")
    members = stage_table(banded.join(shared, "key").select("key", "node", "pivot").distinct(), "members")

    involved = members.select("node").distinct().join(nodes.select("node", "low"), "node")
    involved = stage_table(involved, "involved")
    few = involved.count() <= BROADCAST_IDS
    wanted = involved.select("low").distinct()
    texts = rows.join(F.broadcast(wanted) if few else wanted, F.col("id").eqNullSafe(F.col("low")), "left_semi").select("text")
    texts = texts.mapInArrow(_payload(seed), "node long, text string, bands binary, sig binary")
    texts = texts.join(F.broadcast(involved.select("node")) if few else involved.select("node"), "node", "left_semi")
    texts = stage_table(texts.dropDuplicates(["node"]), "texts")

    first = stage_table(_star_links(members, texts), "star-links")
    roots = connected_components(first)
    second = _block_links(members, roots, texts)
    roots = connected_components(stage_table(first.unionByName(second), "all-links"))

    placed = nodes.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component"))
    labels = placed.join(lows, "root").select(F.col("node").alias("__node"), "component", (F.col("node") == F.col("root")).alias("is_root"))
    found = facts.select("id", "n", "node").join(labels, F.col("node") == F.col("__node"), "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component"))
    kept = component.eqNullSafe(F.col("id")) & (F.col("id").isNotNull() | F.coalesce("is_root", F.lit(True)))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"), "node"), seed


def _star_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links of buckets' members to the least node of the bucket."""
    pairs = members.filter("node <> pivot").select("node", "pivot").distinct()
    sizes = pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / STAR_BLOCK).cast("int").alias("blocks"))
    body = texts.select(F.col("node").alias("x"), "text")
    many = pairs.join(sizes, "pivot").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    many = many.join(body, F.col("node") == F.col("x")).select("pivot", "block", F.lit(1).alias("member"), "node", "text")
    ones = sizes.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ones = ones.join(body, F.col("pivot") == F.col("x")).select("pivot", "block", F.lit(0).alias("member"), F.col("pivot").alias("node"), "text")
    dealt = many.unionByName(ones).repartition("pivot", "block").sortWithinPartitions("pivot", "block", "member")
    return dealt.mapInArrow(_verify_stars, "a long, b long")


def _block_links(members: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links between components that share a bucket."""
    placed = members.select("key", "node").join(roots.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left")
    placed = placed.select("key", "node", F.coalesce("root", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
    mixed = mixed.filter("lo <> hi").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    open_ = placed.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    marks = texts.select(F.col("node").alias("x"), "bands", "sig")
    cells = open_.join(marks, F.col("node") == F.col("x")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "bands", "sig")
    dealt = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "node")
    found = stage_table(dealt.mapInArrow(_promising_cells, "key long, i long, j long, block long, node long"), "promising")
    component = roots.select(F.col("node").alias("y"), "root")
    full = found.join(texts.withColumnRenamed("node", "x"), F.col("node") == F.col("x")).join(component, F.col("node") == F.col("y"), "left")
    full = full.select("key", "i", "j", "block", "node", F.coalesce("root", "node").alias("component"), "bands", "sig", "text")
    dealt = full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "block", "node")
    return dealt.mapInArrow(_verify_blocks, "a long, b long")


def _node_of(seed: int):
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        sets = [shingle_set(t) for t in texts]
        return pd.Series([_digests(s, seed)[0] if len(s) else None for s in sets], dtype="Int64")

    return run


def deduplicated_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group, in the columns of `docs`: that of the least id.

    Of an id that several rows have, each kept text stays once, with any of the rows that have both, and so
    does one row without a word. Rows without an id: one of each group that has no id at all, and all whose
    texts have no word.
    """
    labels, seed = _labelled(docs, id_col, text_col)
    labels = stage_table(labels.select("doc_id", "node", "n_shingles", "kept"), "kept")
    own, held, node = unused(docs, "own", "held", "node")
    counted = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("kept").alias("k"))
    counted = stage_table(counted, "ids")
    is_id = F.col(id_col) == F.col(own)
    rows = docs.join(counted.filter("n = 1 AND k = 1").select(F.col("doc_id").alias(own)), is_id, "left_semi")
    # texts are hashed anew only where an id does not tell its row
    many = docs.join(counted.filter("n > 1 AND k > 0").select(F.col("doc_id").alias(own)), is_id, "left_semi").withColumn(node, _node_of(seed)(F.col(text_col)))
    both = labels.filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(own), F.col("node").alias(held)).distinct()
    many = many.join(both, is_id & F.col(node).eqNullSafe(F.col(held)), "left_semi").dropDuplicates([id_col, node])
    nodes = labels.filter("kept AND doc_id IS NULL AND n_shingles > 0").select(F.col("node").alias(own)).distinct()
    bare = docs.filter(F.col(id_col).isNull()).withColumn(node, _node_of(seed)(F.col(text_col)))
    chosen = bare.join(nodes, F.col(node) == F.col(own), "left_semi").dropDuplicates([node])
    empty = bare.filter(F.col(node).isNull())
    return rows.select(*whole(docs)).unionByName(many.select(*whole(docs))).unionByName(chosen.select(*whole(docs))).unionByName(empty.select(*whole(docs)))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_columns

    return near_duplicates(read_columns(spark, sf_dir, "documents", "doc_id", "text"))


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 75 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
