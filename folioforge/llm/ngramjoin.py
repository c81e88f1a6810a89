"""Jaccard join of word n-gram sets by prefix trees.

A document's set is its distinct 3-word shingles as 64-bit hashes, in the order of the hashes, which is the
same for all sets. Documents of one set are one node. Two filters find the groups that a tree is made of:

1. Two similar sets share at least `least_met` of their first 2p - 1 n-grams, p being the length of the prefix
   that the similarity allows to differ, plus one. So n-grams are counted among these beginnings only, and
   a node of which fewer are met elsewhere is linked with nothing.
2. Of those that are met elsewhere, the rarest are enough: a node of m such n-grams keeps the first
   m - least_met + 1 by frequency, and similar nodes share one of these. Each is the key of a group; of groups
   of the same nodes one stays.

A group's sets are stored in a trie of n-gram runs. A probe block goes down the trie once for all its
sets: the overlap of each probe with the path is added up run by run and shared by everything below, and
probes leave, or the whole subtree is cut, where what remains of either set is too short. At a leaf
the overlap is that of the full sets. First each node meets the least node of one of its groups; then,
in groups that still hold several components, blocks meet blocks: tries of beginnings tell which nodes
may be similar at all, full sets move of those alone, and only links that join components leave the task.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage_table
from .components import connected_components
from .shingles import shingle_set

SIZE = 3
PERCENT = 90
#: A block of a group holds about so many nodes, and n-grams, at most; a longer set is a block of its own.
BLOCK_NODES, BLOCK_GRAMS = 512, 1 << 19
#: Node ids that are broadcast to filter the texts; beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: N-grams of a run that are met with the probes before bounds are tested again.
STEP = 64


def least_overlap(n, percent: int = PERCENT):
    """The n-grams that a set of n has at least in common with a similar one, which is also the least size of that: an integer, or a column."""
    return F.floor((n * percent + 99) / 100) if isinstance(n, Column) else (n * percent + 99) // 100


def may_differ(n, percent: int = PERCENT):
    """One more than the n-grams of a set of n that a similar one may lack."""
    return n - least_overlap(n, percent) + 1


def least_met(n, percent: int = PERCENT):
    """The least number of n-grams that the first 2p - 1 of a set of n and those of a similar set share."""
    return may_differ(least_overlap(n, percent), percent)


def similar_sizes(overlap, a, b, percent: int = PERCENT):
    return 100 * overlap >= percent * (a + b - overlap)


class Trie:
    """Ascending sets in a prefix tree of runs: the sets from `low` to `high` of the sorted rows share `depth` n-grams."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].byteswap().tobytes())  # as big-endian bytes n-grams sort as numbers
        self.sets = [sets[i] for i in self.order]
        self.sizes = np.array([len(s) for s in self.sets])
        self.common = np.zeros(len(sets), np.int64)  # n-grams that a set and the one before begin with
        for i in range(1, len(sets)):
            a, b = self.sets[i - 1], self.sets[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.common[i] = differ[0] if len(differ) else m

    def below(self, low: int, high: int) -> int:
        """The depth down to which the sets are one path."""
        return int(min(self.common[low + 1 : high].min(initial=len(self.sets[low])), len(self.sets[low])))

    def children(self, low: int, high: int, depth: int):
        """(low, high) of the subtrees at a depth where paths part; a set that ends there comes alone."""
        starts = [low, *(low + 1 + np.flatnonzero(self.common[low + 1 : high] <= depth)).tolist(), high]
        return zip(starts, starts[1:], strict=False)


class Probes:
    """Sets to look for, as one ascending array of n-grams and their owners."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        grams, owners = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(grams, kind="stable")
        self.grams, self.owners = grams[order], owners[order]

    def meet(self, run: np.ndarray, start: int, overlap: np.ndarray, passed: np.ndarray) -> int:
        """Add a run's n-grams to the probes' overlaps, and to `passed` all n-grams up to the run's last; the place after it."""
        stop = start + int(np.searchsorted(self.grams[start:], run[-1], side="right"))
        grams, owners = self.grams[start:stop], self.owners[start:stop]
        n = len(self.sizes)
        passed += np.bincount(owners, minlength=n)
        at = np.searchsorted(run, grams)
        overlap += np.bincount(owners[run[np.minimum(at, len(run) - 1)] == grams], minlength=n)
        return stop


class Jaccard:
    """Which full sets are similar, and which may still become so on the way down."""

    def __init__(self, trie: Trie, probes: Probes, percent: int = PERCENT):
        self.trie, self.probes, self.percent = trie, probes, percent

    def open(self, low: int, high: int, depth: int, overlap: np.ndarray, passed: np.ndarray) -> np.ndarray:
        """What a pair can still reach along the longest set of the subtree, and along the probe, would be enough."""
        sizes, b = self.trie.sizes[low:high], self.probes.sizes
        along = overlap + sizes.max() - depth
        reach = np.minimum(along, overlap + b - passed)
        return similar_sizes(along, sizes.max(), b, self.percent) & similar_sizes(reach, sizes.min(), b, self.percent)

    def met(self, row: int, overlap: np.ndarray) -> np.ndarray:
        return similar_sizes(overlap, self.trie.sizes[row], self.probes.sizes, self.percent)


class Beginnings:
    """Whose beginnings share as many n-grams as those of similar sets do.

    left, right: of the trie's rows and of the probes the full sets' sizes, and how many n-grams of a
    beginning were alike in the bits that are kept, by which an overlap may be too small.
    """

    def __init__(self, trie: Trie, probes: Probes, left: tuple, right: tuple, percent: int = PERCENT):
        self.trie, self.probes, self.left, self.right = trie, probes, left[0], right[0]
        self.least = may_differ(left[0], percent) - left[1], may_differ(right[0], percent) - right[1]
        self.percent = percent

    def open(self, low: int, high: int, depth: int, overlap: np.ndarray, passed: np.ndarray) -> np.ndarray:
        reach = overlap + np.minimum(self.trie.sizes[low:high].max() - depth, self.probes.sizes - passed)
        return reach >= np.minimum(self.least[0][low:high].min(), self.least[1])

    def met(self, row: int, overlap: np.ndarray) -> np.ndarray:
        fits = similar_sizes(np.minimum(self.left[row], self.right), self.left[row], self.right, self.percent)
        return fits & (overlap >= np.minimum(self.least[0][row], self.least[1]))


def join(trie: Trie, probes: Probes, rule, skip=None):
    """(row of the trie's order, probe, overlap) of all pairs that `rule` finds met.

    skip(low, high): the probes that need not go on into the subtree of those rows.
    """
    n = len(probes.sizes)
    stack = [(0, len(trie.sets), 0, 0, np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool))]
    while stack:
        low, high, depth, start, overlap, passed, alive = stack.pop()
        end, path = trie.below(low, high), trie.sets[low]
        if skip is not None:
            alive = alive & ~skip(low, high)
        while True:
            alive = alive & rule.open(low, high, depth, overlap, passed)
            if depth >= end or not alive.any():
                break
            stop = min(depth + STEP, end)
            overlap, passed = overlap.copy(), passed.copy()
            start = probes.meet(path[depth:stop], start, overlap, passed)
            depth = stop
        if not alive.any():
            continue
        if high - low == 1:
            for probe in np.flatnonzero(alive & rule.met(low, overlap)):
                yield low, int(probe), int(overlap[probe])
            continue
        stack += [(a, b, depth, start, overlap, passed, alive) for a, b in trie.children(low, high, depth)]


def _digests(s: np.ndarray, seed: int) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set."""
    a, b = xxhash.xxh3_128_intdigest(s.tobytes(), seed=seed).to_bytes(16, "big")[:8], xxhash.xxh64_digest(s.tobytes(), seed=seed)
    return int.from_bytes(a, "big", signed=True), int.from_bytes(b, "big", signed=True)


def _profile(seed: int, size: int, percent: int):
    """(id, text) -> (id, n, node, check, grams): grams are the set's first 2p - 1."""

    def run(batches):
        for batch in batches:
            n, node, check, grams = [], [], [], []
            for text in batch["text"].to_pylist():
                s = shingle_set(text, size)
                n.append(len(s))
                a, b = _digests(s, seed) if len(s) else (None, None)
                node.append(a)
                check.append(b)
                grams.append(s[: 2 * may_differ(len(s), percent) - 1].view(np.int64) if len(s) else None)
            columns = [batch["id"], pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(grams, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "node", "check", "grams"])

    return run


def _sets(seed: int, size: int):
    """text -> (node, set)."""

    def run(batches):
        for batch in batches:
            sets = [s for s in (shingle_set(text, size) for text in batch["text"].to_pylist()) if len(s)]
            nodes = pa.array([_digests(s, seed)[0] for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([nodes, pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "grams"])

    return run


def _values(column: pa.Array) -> list:
    """Python's values; of a list column arrays."""
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    flat, at = column.values.to_numpy(), column.offsets.to_pylist()
    return [flat[a:b] for a, b in zip(at, at[1:], strict=False)]


def _rows(batches, columns: list[str]):
    for batch in batches:
        yield from zip(*(_values(batch[c]) for c in columns), strict=True)


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _unpacked(grams: bytes) -> np.ndarray:
    return np.frombuffer(grams, np.uint64)


def _stars(percent: int):
    """Rows by (pivot, block), the pivot's own first: links of the block's trie with the pivot."""

    def run(batches):
        for (pivot, _), rows in groupby(_rows(batches, ["pivot", "block", "member", "node", "grams"]), key=lambda r: r[:2]):
            held = [(node, _unpacked(grams)) for _, _, _, node, grams in rows]
            if held[0][0] == pivot and len(held) > 1:
                trie, probes = Trie([s for _, s in held[1:]]), Probes([held[0][1]])
                found = [(held[1 + trie.order[low]][0], pivot) for low, _, _ in join(trie, probes, Jaccard(trie, probes, percent))]
                if found:
                    yield _links(found)

    return run


class _Components:
    """Components of the rows of a cell, joined as links are found."""

    def __init__(self, components: list[int]):
        places: dict[int, int] = {}
        self.of = np.array([places.setdefault(c, len(places)) for c in components])

    def join(self, a: int, b: int) -> bool:
        x, y = self.of[a], self.of[b]
        if x != y:
            self.of[self.of == max(x, y)] = min(x, y)
        return bool(x != y)


class _Cell:
    """The first rows as probes and the others, or where there are none all of them, as a trie."""

    def __init__(self, components: list[int], sets: list[np.ndarray], first: int):
        kept = list(range(first if first < len(sets) else 0, len(sets)))
        self.trie, self.probes = Trie([sets[i] for i in kept]), Probes(sets[:first])
        self.rows = [kept[i] for i in self.trie.order]
        self.parts, self.first = _Components(components), first

    def skip(self, low: int, high: int) -> np.ndarray:
        """Probes of the one component that all sets of a subtree belong to."""
        own = self.parts.of[self.rows[low:high]]
        return self.parts.of[: self.first] == own[0] if (own == own[0]).all() else np.zeros(self.first, bool)


def promising(key: int, components: list[int], sizes: list[int], beginnings: list[np.ndarray], keys: list[np.ndarray], first: int, percent: int = PERCENT) -> list[int]:
    """The rows of which another component's row shares enough of the beginning; beginnings: of their n-grams, those that are met elsewhere.

    keys: the groups of each row, ascending. A pair that several groups hold belongs to the first of them.
    """
    distinct = [np.unique(b) for b in beginnings]
    alike = np.array([len(b) - len(d) for b, d in zip(beginnings, distinct, strict=True)])
    cell, n = _Cell(components, distinct, first), np.array(sizes)
    rule, found = Beginnings(cell.trie, cell.probes, (n[cell.rows], alike[cell.rows]), (n[:first], alike[:first]), percent), set()
    owned = [set(k[: np.searchsorted(k, key)].tolist()) for k in keys]
    for low, probe, _ in join(cell.trie, cell.probes, rule, cell.skip):
        row = cell.rows[low]
        if cell.parts.of[row] != cell.parts.of[probe] and owned[row].isdisjoint(owned[probe]):
            found |= {row, probe}
    return sorted(found)


def cell_links(nodes: list[int], components: list[int], sets: list[np.ndarray], first: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join components: of the first `first` rows with the others, or among all of them if there are no others."""
    cell, found = _Cell(components, sets, first), []
    for low, probe, _ in join(cell.trie, cell.probes, Jaccard(cell.trie, cell.probes, percent), cell.skip):
        if cell.parts.join(cell.rows[low], probe):
            found.append((nodes[cell.rows[low]], nodes[probe]))
    return found


_CELL = ["key", "i", "j", "block", "node"]


def _held(batches, columns: list[str]):
    """(cell, its rows, the number of those of block i, which come first), for cells with something to compare."""
    for cell, rows in groupby(_rows(batches, columns), key=lambda r: r[:3]):
        held = list(rows)
        first = sum(r[3] == cell[1] for r in held)
        if first and (first < len(held) if cell[1] < cell[2] else first > 1):
            yield cell, held, first


def _promising_cells(percent: int):
    def run(batches):
        for cell, held, first in _held(batches, [*_CELL, "component", "n", "met", "keys"]):
            rows = promising(cell[0], [r[5] for r in held], [r[6] for r in held], [r[7].view(np.uint32) for r in held], [r[8] for r in held], first, percent)
            if rows:
                columns = zip(*[(*cell, held[k][3], held[k][4]) for k in rows], strict=True)
                yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in zip(_CELL, columns, strict=True)})

    return run


def _linked_cells(percent: int):
    def run(batches):
        for _, held, first in _held(batches, [*_CELL, "component", "grams"]):
            links = cell_links([r[4] for r in held], [r[5] for r in held], [_unpacked(r[6]) for r in held], first, percent)
            if links:
                yield _links(links)

    return run


def _groups(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Groups (key, node, n, pivot, blocks) of nodes of which similar ones share at least one; pivot is a group's least node. And (node, n, met): 32 bits of each n-gram of a beginning that is met elsewhere."""
    grams = nodes.select("node", "n", F.explode("grams").alias("key"))
    shared = grams.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    met = grams.join(shared, "key").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("met"))  # of one text
    spare = (F.size("met") - least_met(F.col("n"), percent) + 1).cast("int")
    small = lambda x: (x["key"].bitwiseAND(F.lit(0xFFFFFFFF)) - F.lit(1 << 31)).cast("int")
    first = F.transform(F.slice("met", F.lit(1), spare), lambda x: x["key"])
    met = stage_table(met.filter(spare > 0).select("node", "n", F.transform("met", small).alias("met"), first.alias("keys")), "gram-met")
    keys = met.select("node", "n", F.explode("keys").alias("key"))
    keys = stage_table(keys, "gram-keys")
    marks = [F.bit_xor(F.xxhash64("node", F.lit(salt))).alias(f"mark{salt}") for salt in (1, 2)]
    groups = keys.groupBy("key").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("total"), F.min("node").alias("pivot"), *marks).filter("nodes > 1")
    groups = groups.groupBy("nodes", "total", "pivot", "mark1", "mark2").agg(F.min("key").alias("key"))
    blocks = F.ceil(F.greatest(F.col("nodes") / BLOCK_NODES, F.col("total") / BLOCK_GRAMS)).cast("int")
    return stage_table(keys.join(groups.select("key", "pivot", blocks.alias("blocks")), "key"), "gram-groups"), met


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("node"), F.col(blocks)).cast("int")


def _star_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of each node with the least pivot of its groups."""
    pairs = groups.groupBy("node", "n").agg(F.min("pivot").alias("pivot")).filter("node <> pivot")
    need = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n") / BLOCK_GRAMS)).cast("int")
    sizes = stage_table(pairs.groupBy("pivot").agg(need.alias("blocks")), "star-sizes")
    body = sets.select(F.col("node").alias("x"), "grams")
    many = pairs.join(sizes, "pivot").withColumn("block", _block("blocks")).join(body, F.col("node") == F.col("x"))
    ones = sizes.join(body, F.col("pivot") == F.col("x")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = many.select("pivot", "block", F.lit(1).alias("member"), "node", "grams").unionByName(ones.select("pivot", "block", F.lit(0).alias("member"), F.col("pivot").alias("node"), "grams"))
    return rows.repartition("pivot", "block").sortWithinPartitions("pivot", "block", "member").mapInArrow(_stars(percent), "a long, b long")


def _cell_links(groups: DataFrame, met: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a group. Beginnings are compared before full sets move."""
    placed = groups.select("key", "node", "n", "blocks").join(roots.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left")
    placed = placed.select("key", "node", "n", "blocks", F.coalesce("root", "node").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select(F.col("key").alias("open"))
    rows = placed.join(mixed, F.col("key") == F.col("open"), "left_semi").withColumn("block", _block("blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "n", "component")
    own = groups.groupBy(F.col("node").alias("y")).agg(F.array_sort(F.collect_list("key")).alias("keys"))  # of one text
    marks = met.select(F.col("node").alias("x"), "met").join(own, F.col("x") == F.col("y")).select("x", "met", "keys")
    rows = rows.join(marks, F.col("node") == F.col("x")).drop("x")
    dealt = lambda df: df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.col("block") != F.col("i"), "node")
    found = stage_table(dealt(rows).mapInArrow(_promising_cells(percent), "key long, i long, j long, block long, node long"), "gram-promising")
    full = found.join(sets.select(F.col("node").alias("x"), "grams"), F.col("node") == F.col("x"))
    full = full.join(roots.withColumnRenamed("node", "y"), F.col("node") == F.col("y"), "left").select(*_CELL, F.coalesce("root", "node").alias("component"), "grams")
    return dealt(full).mapInArrow(_linked_cells(percent), "a long, b long")


def jaccard_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id. Ids may be of any type that has an order.

    A set is the distinct runs of `size` words, A-Z lower-cased; a shorter text is one run. Two documents are
    linked where 100 * intersection >= percent * union; component_id is the least id that links reach.

    Null, empty or blank text: no n-gram, its own component. Null id: takes part in links; its component_id
    is the least id of the component, null if that has none. Repeated rows of an id: each has its row; their
    texts are nodes of their own, which the id does not link. Empty table: empty result. Other columns are
    not read. Results are the same for any order and partitioning of the rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    for seed in range(8):
        facts = stage_table(rows.mapInArrow(_profile(seed, size, percent), f"id {kind}, n long, node long, check long, grams array<long>"), "gram-facts")
        per = facts.filter("node IS NOT NULL").groupBy("node")
        tally = [F.min("id").alias("low"), F.min("n").alias("n"), (F.min("check") != F.max("check")).alias("clash"), F.first("grams").alias("grams")]
        nodes = stage_table(per.agg(*tally), "gram-nodes")
        if not nodes.filter("clash").limit(1).count():
            break  # else two sets have one hash: hash anew
    else:
        raise RuntimeError("different sets keep the same 64-bit hash")

    groups, met = _groups(nodes, percent)
    involved = stage_table(groups.select("node").distinct().join(nodes.select("node", "low"), "node"), "gram-involved")
    few = involved.count() <= BROADCAST_IDS
    wanted, known = involved.select("low").distinct(), involved.select("node")
    texts = rows.join(F.broadcast(wanted) if few else wanted, F.col("id").eqNullSafe(F.col("low")), "left_semi").select("text")
    sets = texts.mapInArrow(_sets(seed, size), "node long, grams binary").join(F.broadcast(known) if few else known, "node", "left_semi")
    sets = stage_table(sets.dropDuplicates(["node"]), "gram-sets")

    stars = stage_table(_star_links(groups, sets, percent), "gram-stars")
    roots = connected_components(stars)
    cells = _cell_links(groups, met, roots, sets, percent)
    roots = connected_components(stage_table(stars.unionByName(cells), "gram-links"))

    placed = nodes.join(roots.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lows = placed.groupBy("root").agg(F.min("low").alias("component"))
    labels = placed.join(lows, "root").select(F.col("node").alias("x"), "component")
    found = facts.select("id", "n", "node").join(labels, F.col("node") == F.col("x"), "left")
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component")).alias("component_id"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_columns

    return jaccard_groups(read_columns(spark, sf_dir, "documents", "doc_id", "text"))


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
