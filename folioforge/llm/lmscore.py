"""Language-model scores from a log-frequency Bloom filter.

Words and word pairs of the training documents are counted by hash: each task sorts and sums what it has
read and sends one blob per shard of the hash range; a shard's blobs are merged in one task. Shards are
as many as the training text asks for, so that a shard's size does not grow with the input.

The filter holds the logarithm of counts: an n-gram of level q = 1 + floor(log(count) / log(BASE)) is
entered once for each level up to q, and its level is read back by probing one level after the other.
It is one segment per shard, sized by the shard's own entries, so that every level of every n-gram is
kept at any size. No task holds more than one segment: the distinct n-grams of packs of documents are
sent to their shards, and their levels come back to the pack. Exact counts for the base score come from
the most frequent HEAD words, which are broadcast, and for all others from a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage_table
from .shingles import _finish, word_hashes

BASE = 1.5
MAX_LEVEL = 120
BITS_PER_ENTRY = 10
#: Bits of the smallest segment.
SEGMENT_BITS = 8192
PROBES = 6
#: Words whose exact counts are broadcast.
HEAD = 1 << 20
#: Bytes of training text per shard of the counts.
SHARD_BYTES = 32 << 20
#: Weight of the unigram distribution against a history's own count.
PRIOR = 1000.0
_FLUSH = 3_000_000
#: Words of a pack of documents, whose distinct n-grams are looked up together.
_TOKENS = 800_000
END, START = np.uint64(0x5DEECE66D1234567), np.uint64(0x2545F4914F6CDD1D)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
#: Low bits that hashes leave 0, by kind: words have 64 bits, word pairs 48.
_ZEROS = (np.uint64(0), np.uint64(16))
#: Keys that are looked up in a segment at a time.
_ASKED = 1_000_000


def token_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, A-Z lower-cased, and of the end."""
    return np.append(word_hashes(text), END)


def pair_hashes(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """48-bit hash of (history, token), in the upper bits, for concatenated documents that begin at `begins`."""
    return (_finish(histories(tokens, begins) * _PAIR + tokens) >> _ZEROS[1]) << _ZEROS[1]


def histories(tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[begins] = START
    return before


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 for a count of 1, and one more for each factor BASE."""
    edges = np.ceil(BASE ** np.arange(MAX_LEVEL) - 1e-9)
    return np.searchsorted(edges, counts, side="right")


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level; 0 for level 0."""
    low = np.ceil(BASE ** np.arange(MAX_LEVEL) - 1e-9)
    middle = np.concatenate([[0.0], (low[:-1] + np.maximum(low[:-1], low[1:] - 1)) / 2])
    return middle[np.minimum(levels, len(middle) - 1)]


def _squeezed(values: np.ndarray) -> bytes:
    """Unsigned values by byte planes: the higher ones are nearly all zero."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def _expanded(blob: pa.Scalar, kind) -> np.ndarray:
    held = blob.as_buffer()
    planes = pa.decompress(held[8:], decompressed_size=int.from_bytes(held[:8].to_pybytes(), "little"), codec="zstd")
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _squeezed_keys(keys: np.ndarray, kind: int) -> bytes:
    """Hashes as their differences, which are small where they ascend."""
    return _squeezed(np.diff(keys >> _ZEROS[kind], prepend=np.uint64(0)))


def _expanded_keys(blob: pa.Scalar, kind: int) -> np.ndarray:
    return np.cumsum(_expanded(blob, np.uint64), dtype=np.uint64) << _ZEROS[kind]


def _counted(parts: list[np.ndarray], kind: int, shards: int):
    keys, counts = np.unique(np.concatenate(parts), return_counts=True)
    shard = shard_of(keys, shards)
    ends = np.searchsorted(shard, np.arange(shards + 1, dtype=np.uint64))
    used = np.flatnonzero(ends[1:] > ends[:-1]).tolist()
    counts = counts.astype(np.uint32)
    return pa.RecordBatch.from_pydict(
        {
            "kind": pa.array([kind] * len(used), pa.int32()),
            "shard": pa.array(used, pa.int64()),
            "keys": pa.array([_squeezed_keys(keys[ends[s] : ends[s + 1]], kind) for s in used], pa.binary()),
            "counts": pa.array([_squeezed(counts[ends[s] : ends[s + 1]]) for s in used], pa.binary()),
        }
    )


def _count(shards: int):
    def run(batches):
        words, pairs, held = [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                docs = [token_hashes(t) for t in batch["text"].slice(start, 512).to_pylist()]
                tokens = np.concatenate(docs)
                begins = np.cumsum([0] + [len(d) for d in docs[:-1]])
                words.append(tokens)
                pairs.append(pair_hashes(tokens, begins))
                held += len(tokens)
                if held > _FLUSH:
                    yield _counted(words, 0, shards)
                    yield _counted(pairs, 1, shards)
                    words, pairs, held = [], [], 0
        if held:
            yield _counted(words, 0, shards)
            yield _counted(pairs, 1, shards)

    return run


def _merge(group: pa.Table) -> pa.Table:
    """One shard of one kind: its segment of the filter and, of words, the distinct keys with summed counts."""
    kind = group["kind"][0].as_py()
    keys = np.concatenate([_expanded_keys(x, kind) for x in group["keys"]])
    counts = np.concatenate([_expanded(x, np.uint32) for x in group["counts"]])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    keys, counts = keys[begins], np.add.reduceat(counts, begins)
    distinct, total = len(keys), int(counts.sum())
    levels = level_of(counts)
    histogram = [np.zeros(MAX_LEVEL + 1, dtype=np.int64) for _ in range(2)]
    histogram[kind] = np.bincount(levels, minlength=MAX_LEVEL + 1)
    first, bits = filter_shape(histogram, 1)
    if kind == 1:  # pairs are read from the filter alone
        row_keys, row_counts = b"", b""
    else:
        row_keys, row_counts = keys.tobytes(), counts.tobytes()
    row = {"kind": pa.array([kind], pa.int32()), "shard": group["shard"].slice(0, 1).combine_chunks(), "n": pa.array([distinct], pa.int64()), "total": pa.array([total], pa.int64())}
    row |= {"keys": pa.array([row_keys], pa.binary()), "counts": pa.array([row_counts], pa.binary())}
    row["levels"] = pa.array([histogram[kind].tolist()], pa.list_(pa.int64()))
    row["segment"] = pa.array([segment(keys, levels, first[kind], bits[kind])], pa.binary())
    return pa.table(row)


_COUNTS = "kind int, shard long, n long, total long, keys binary, counts binary, levels array<long>, segment binary"


@dataclass
class Filter:
    """A log-frequency Bloom filter in one segment for each kind and shard."""

    shards: int
    first: tuple[int, int]  # lowest level that is entered, by kind
    bits: tuple[int, int]  # bits of a segment, by kind
    data: tuple[np.ndarray, np.ndarray]

    def places(self, kind: int, hashes: np.ndarray, level: int, probe: int) -> np.ndarray:
        return _places(hashes, level, probe, self.bits[kind])

    def levels(self, kind: int, hashes: np.ndarray) -> np.ndarray:
        """Level of each n-gram; 0 if it is below the first."""
        found = np.zeros(len(hashes), dtype=np.int64)
        base = shard_of(hashes, self.shards).astype(np.int64) * self.bits[kind]
        left = np.arange(len(hashes))
        for level in range(self.first[kind], MAX_LEVEL):
            for probe in range(PROBES):
                if not len(left):
                    return found
                at = base[left] + _places(hashes[left], level, probe, self.bits[kind])
                left = left[(self.data[kind][at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            found[left] = level
        return found


def _places(hashes: np.ndarray, level: int, probe: int, bits: int) -> np.ndarray:
    g = _finish(hashes + np.uint64((level * 0x9E3779B97F4A7C15) & (2**64 - 1)))
    step = (g >> np.uint64(32)) | np.uint64(1)
    return (((g & np.uint64(0xFFFFFFFF)) + np.uint64(probe) * step) % np.uint64(bits)).astype(np.int64)


def segment(hashes: np.ndarray, levels: np.ndarray, first: int, bits: int) -> bytes:
    """The bits of one shard: every n-gram at each of its levels from `first` on."""
    flags = np.zeros(bits, dtype=bool)
    for level in range(first, int(levels.max(initial=0)) + 1):
        hashes, levels = hashes[levels >= level], levels[levels >= level]
        for probe in range(PROBES):
            flags[_places(hashes, level, probe, bits)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def filter_shape(histogram: list[np.ndarray], shards: int, max_bits: int = 1 << 62) -> tuple[tuple[int, int], tuple[int, int]]:
    """First level and bits of a segment, of words and of word pairs; without `max_bits` all levels are kept.

    With it the lowest levels are left out, the fewest that make it fit; words may take half of it at most.
    """
    first, bits = [], []
    for kind, share in ((0, max_bits // 2), (1, None)):
        share = max_bits - bits[0] * shards if share is None else share
        n = histogram[kind]
        level = 1
        entries = lambda lowest: int(sum((q - lowest + 1) * n[q] for q in range(lowest, len(n))))
        while level < MAX_LEVEL - 1 and entries(level) * BITS_PER_ENTRY > share:
            level += 1
        first.append(level)
        # a shard of few n-grams may hold far more entries than the mean
        least = max(64, min(SEGMENT_BITS, share // shards // 64 * 64))
        bits.append(max(least, -(-entries(level) * BITS_PER_ENTRY // shards + 63) // 64 * 64))
    return tuple(first), tuple(bits)


@dataclass
class Model:
    shards: int
    segments: DataFrame  # kind, shard, segment: the filter
    train_tokens: int  # N
    train_docs: int
    vocabulary: int  # V
    head_keys: np.ndarray
    head_counts: np.ndarray
    prior: float = PRIOR

    @property
    def norm(self) -> float:
        return self.train_tokens + 0.1 * (self.vocabulary + 1)


def log_probabilities(c_word: np.ndarray, c_pair: np.ndarray, begins: np.ndarray, train_docs: int, norm: float, prior: float) -> np.ndarray:
    """log10 P(token | the one before), Dirichlet-smoothed with the add-0.1 unigram; counts of each token and of the pair it ends."""
    c_before = np.empty(len(c_word))
    c_before[1:] = c_word[:-1]
    c_before[begins] = train_docs
    c_pair = np.minimum(c_pair, np.minimum(c_word, c_before))
    return np.log10((c_pair + prior * (c_word + 0.1) / norm) / (c_before + prior))


def train(docs: DataFrame, *, text_col: str = "text", head: int = HEAD, shard_bytes: int = SHARD_BYTES, prior: float = PRIOR) -> tuple[Model, DataFrame]:
    """A model of all whole texts of `docs`, and the table of the words beyond the head with their counts.

    Null and empty texts are one token, the end; repeated rows are learned from each time. Empty table: a
    model whose counts are all 0. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    text = docs.select(F.col(text_col).alias("text"))
    n_docs, size = text.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(16, -(-size // shard_bytes))
    # as many tasks as groups, whatever the session's number: a task holds one shard
    parts = text.mapInArrow(_count(shards), "kind int, shard long, keys binary, counts binary").repartition(2 * shards, "kind", "shard")
    counts = stage_table(parts.groupBy("kind", "shard").applyInArrow(_merge, _COUNTS), "ngram-counts")
    sums = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect()}
    n, v = (sums[0]["total"], sums[0]["n"]) if 0 in sums else (0, 0)
    histogram = [np.zeros(MAX_LEVEL + 1, dtype=np.int64) for _ in range(2)]
    for r in counts.select("kind", F.posexplode("levels").alias("level", "x")).groupBy("kind", "level").agg(F.sum("x").alias("x")).collect():
        histogram[r["kind"]][r["level"]] = r["x"]
    lowest = MAX_LEVEL
    while lowest > 1 and histogram[0][lowest - 1 :].sum() <= head:
        lowest -= 1
    top = counts.filter("kind = 0").select("keys", "counts").mapInArrow(_word_rows(lowest, MAX_LEVEL), "key long, c long").toArrow()
    keys = top["key"].to_numpy().view(np.uint64) if top.num_rows else np.empty(0, np.uint64)
    order = np.argsort(keys)
    model = Model(shards, counts.select("kind", "shard", "segment"), n or 0, n_docs, v or 0, keys[order], top["c"].to_numpy()[order] if top.num_rows else np.empty(0, np.int64), prior)
    tail = counts.filter("kind = 0").select("keys", "counts").mapInArrow(_word_rows(1, lowest - 1), "key long, c long")
    return model, tail


def _word_rows(low: int, high: int):
    """Words whose levels are from low to high, with their counts."""

    def run(batches):
        for batch in batches:
            for keys, own in zip(batch["keys"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                c = np.frombuffer(own, np.int64)
                level = level_of(c)
                fits = (level >= low) & (level <= high)
                yield pa.RecordBatch.from_pydict({"key": np.frombuffer(keys, np.int64)[fits], "c": c[fits]})

    return run


def _packs(batches):
    """Rows of ids and tokens of consecutive documents: distinct words by falling frequency, and the place of each token among them."""
    ids, docs, held = [], [], 0
    for batch in batches:
        texts, start = batch["text"].to_pylist(), 0
        for k, text in enumerate(texts):
            docs.append(token_hashes(text))
            held += len(docs[-1])
            if held >= _TOKENS:
                ids.append(batch["id"].slice(start, k + 1 - start))
                yield _pack(ids, docs)
                ids, docs, held, start = [], [], 0, k + 1
        if start < len(texts):
            ids.append(batch["id"].slice(start))
    if docs:
        yield _pack(ids, docs)


def _pack(ids: list[pa.Array], docs: list[np.ndarray]) -> pa.RecordBatch:
    words, at, times = np.unique(np.concatenate(docs), return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    place = np.empty(len(words), dtype=np.uint32)
    place[order] = np.arange(len(words), dtype=np.uint32)
    held = pa.concat_arrays(ids)
    return pa.RecordBatch.from_pydict(
        {
            "ids": pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held),
            "sizes": pa.array([[len(d) for d in docs]], pa.list_(pa.int64())),
            "words": pa.array([_squeezed_keys(words[order], 0)], pa.binary()),
            "places": pa.array([_squeezed(place[at])], pa.binary()),
        }
    )


def _unpack(sizes, words, places) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes of the documents and their begins, the words and each token's place among them."""
    sizes = np.array(sizes.as_py(), dtype=np.int64)
    return sizes, np.cumsum(sizes) - sizes, _expanded_keys(words, 0), _expanded(places, np.uint32)


def _asked(shards: int):
    """The distinct words and word pairs of each pack, ascending, a row for each shard that has some."""

    def run(batches):
        for batch in batches:
            for pack, *packed in zip(batch["pack"], batch["sizes"], batch["words"], batch["places"], strict=True):
                _, begins, words, at = _unpack(*packed)
                for kind, keys in ((0, np.sort(words)), (1, np.unique(pair_hashes(words[at], begins)))):
                    ends = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1, dtype=np.uint64))
                    used = np.flatnonzero(ends[1:] > ends[:-1]).tolist()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "pack": pa.array([pack.as_py()] * len(used), pa.int64()),
                            "kind": pa.array([kind] * len(used), pa.int32()),
                            "shard": pa.array(used, pa.int64()),
                            "keys": pa.array([_squeezed_keys(keys[ends[s] : ends[s + 1]], kind) for s in used], pa.binary()),
                        }
                    )

    return run


def _answer(asked: pa.Table, segments: pa.Table) -> pa.Table:
    """One shard of one kind: the levels of what each pack asks for, a byte each."""
    levels, parts, held = [], [], 0
    if segments.num_rows:
        data = np.frombuffer(segments["segment"][0].as_buffer(), np.uint8)
        own = Filter(1, (1, 1), (8 * len(data),) * 2, (data, data))
    for k, (blob, kind) in enumerate(zip(asked["keys"], asked["kind"].to_pylist(), strict=True)):
        parts.append(_expanded_keys(blob, kind))
        held += len(parts[-1])
        if held >= _ASKED or k == asked.num_rows - 1:
            keys, at = np.unique(np.concatenate(parts), return_inverse=True)
            found = own.levels(kind, keys).astype(np.uint8)[at] if segments.num_rows else np.zeros(held, np.uint8)
            levels += [_squeezed(x) for x in np.split(found, np.cumsum([len(p) for p in parts])[:-1])]
            parts, held = [], 0
    return pa.table({"pack": asked["pack"], "kind": asked["kind"], "shard": asked["shard"], "levels": pa.array(levels, pa.binary())})


def score(docs: DataFrame, model: Model, tail: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_tokens, n_known, train_tokens, base_score, score.

    n_known and base_score rest on exact counts, score on the filter: the log10 probability of the text by
    a bigram model. Null text: as the empty text, whose one token is the end. No training documents: all
    counts are 0, and every token has the same probability. Null and repeated ids: a row each.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.head_keys, model.head_counts))
    train_docs, norm, prior = model.train_docs, model.norm, model.prior

    def run(packs: pa.Table, answers: pa.Table) -> pa.Table:
        head_keys, head_counts = shared.value
        sizes, begins, words, at = _unpack(packs["sizes"][0], packs["words"][0], packs["places"][0])
        tokens = words[at]
        # shards are ranges of the hash: their answers one after the other are those of the ascending keys
        levels = [[], []]
        for i in np.argsort(answers["shard"].to_numpy(), kind="stable").tolist():
            levels[answers["kind"][i].as_py()].append(_expanded(answers["levels"][i], np.uint8))
        c_word = np.empty(len(words))
        c_word[np.argsort(words)] = count_of(np.concatenate(levels[0]))
        _, pair_at = np.unique(pair_hashes(tokens, begins), return_inverse=True)
        c_pair = count_of(np.concatenate(levels[1]))[pair_at]
        scores = np.add.reduceat(log_probabilities(c_word[at], c_pair, begins, train_docs, norm, prior), begins)
        place = np.minimum(np.searchsorted(head_keys, words), max(0, len(head_keys) - 1))
        known = head_keys[place] == words if len(head_keys) else np.zeros(len(words), bool)
        c = np.where(known, head_counts[place], 0) if len(head_keys) else np.zeros(len(words))
        base = np.add.reduceat(np.where(known, np.log10(c + 0.1), 0.0)[at], begins)
        n_head = np.add.reduceat(known[at].astype(np.int64), begins)
        rest = np.flatnonzero(~known[at])
        owner = np.searchsorted(begins, rest, side="right") - 1
        offsets = np.searchsorted(owner, np.arange(len(sizes) + 1)).astype(np.int32)
        others = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens[rest].view(np.int64)))
        return pa.Table.from_arrays(
            [packs["ids"].combine_chunks().flatten(), pa.array(sizes), pa.array(n_head), pa.array(base), pa.array(scores), others],
            names=["id", "n_tokens", "n_head", "head_score", "score", "others"],
        )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    packs = rows.mapInArrow(_packs, f"ids array<{kind}>, sizes array<long>, words binary, places binary")
    packs = stage_table(packs.withColumn("pack", F.monotonically_increasing_id()), "token-packs")
    asked = packs.select("pack", "sizes", "words", "places").mapInArrow(_asked(model.shards), "pack long, kind int, shard long, keys binary").repartition(2 * model.shards, "kind", "shard")
    answers = asked.groupBy("kind", "shard").cogroup(model.segments.groupBy("kind", "shard")).applyInArrow(_answer, "pack long, kind int, shard long, levels binary")
    scored = packs.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, f"id {kind}, n_tokens long, n_head long, head_score double, score double, others array<long>")
    scored = stage_table(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    # words outside the head: summed within a document, then joined with their counts
    used = scored.select("row", F.explode("others").alias("key")).groupBy("row", "key").agg(F.count(F.lit(1)).alias("times"))
    used = used.join(tail, "key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = used.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.col("c") + 0.1)).alias("rest_score"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rest_known")
    )
    return scored.join(rest, "row", "left").select(
        "id", "n_tokens", (F.col("n_head") + F.coalesce("rest_known", F.lit(0))).alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("rest_score", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(model.norm))).alias("base_score"), "score",
    )


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, mod 10, is 0; null for a null id, which is neither learned from nor held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 == 0


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_columns

    docs = read_columns(spark, sf_dir, "documents", "doc_id", "text")
    model, tail = train(docs.filter(~held_out()))
    scored = score(docs, model, tail)
    return scored.withColumnRenamed("id", "doc_id").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
