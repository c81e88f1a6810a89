"""Token ids in raw binary shards, with a minimal perfect hash index from document keys to shard offsets.

Shard file:  magic, id width in bytes (u32), zero (u32) | ids, little-endian, document after document |
             key (i64), key is null (u8), number of ids (u64) of each record | records (u64), ids (u64), magic
Index file:  magic, numpy arrays by name (npz): the levels of the hash, and for each slot fingerprint (u32),
             shard, record in the shard (u32), first id, number of ids, records of the key (u64)
shards.tab:  64 bytes a shard in ascending key order: name, ids, ids of all shards before, records, records without a key
index.tab:   32 bytes an index file: name, by bucket
manifest.json: numbers of shards, shards with records without a key, buckets, width of an id

Documents are range-partitioned by key; a task encodes and writes one shard, in key order. A key of very
many records goes over into further shards. A file's name is new for each attempt, and only files that a
finished task reported are in the tables, so attempts that died leave nothing that is read. Whoever looks
a key up reads two small records and one index file, however many there are. Files are opened through
pyarrow's file systems by URI.
"""

from __future__ import annotations

import io
import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import caches
from .common import fresh_path, small_batches

MAGIC = b"FFIDS001"
INDEX_MAGIC = b"FFMPH001"
END_ID = 2
#: Documents of an index file, on average.
INDEX_BUCKET = 65_536
_HEAD = 16
_TAIL = 24
_CACHE = 800_000
_FLUSH = 8 << 20
#: Ids of neighbouring records that are read at once.
_AT_ONCE = 1 << 20
_SHARD = struct.Struct("<32sQQQQ")


# --- encoding ---------------------------------------------------------------------------------------


class Encoder:
    """Ids of whole texts as raw little-endian bytes, from a `tokenizers` file of a byte-level BPE.

    A pre-token's ids do not depend on its neighbours, so the library is asked once for each distinct
    pre-token, many at a time with line feeds between them. A text with a character outside the plain
    ranges, or with the content of an added token, goes to the library as a whole, as it might be split
    there in another way.
    """

    PIECES = re.compile(r" ?[^\W\d_]+|'(?:[stmd]|re|ve|ll)| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
    ODD = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]")

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(file)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # each piece is asked for once, so that the library's own memory only costs time
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.dtype = np.dtype(f"<u{self.width}")
        plain = json.loads(self.tokenizer.to_str())
        before = plain.get("pre_tokenizer") or {}
        self.by_piece = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and plain.get("normalizer") is None
        self.added = tuple(t["content"] for t in plain.get("added_tokens") or [])
        self.feed = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.known: dict[str, bytes | bool] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _learn(self, fresh: list[str]) -> None:
        """Ids of pieces that are not known yet; False for odd ones."""
        if self.ODD.search("\n".join(fresh)):
            self.known.update((p, False) for p in fresh if self.ODD.search(p))
            fresh = [p for p in fresh if p not in self.known]
        blank = [p for p in fresh if p.isspace()] if len(self.feed) == 1 else fresh
        for piece in blank:
            self.known[piece] = self._whole(piece)
        joined = [p for p in fresh if p not in self.known] if blank else fresh
        if joined:
            found = self.tokenizer.encode_batch_fast(["\n".join(joined)], add_special_tokens=False)[0].ids
            ids = np.array(found, dtype=self.dtype)
            ends = np.append(np.flatnonzero(ids == self.feed[0]), len(ids)).tolist()
            raw, width, start = ids.tobytes(), self.width, 0
            for piece, end in zip(joined, ends, strict=True):
                self.known[piece] = raw[start * width : end * width]
                start = end + 1

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The raw ids of each text in turn; give it some hundred texts at a time."""
        if not self.by_piece:
            for text in texts:
                yield self._whole(text)
            return
        if len(self.known) > _CACHE:
            self.known.clear()
        split = [None if any(x in text for x in self.added) else self.PIECES.findall(text) for text in texts]
        self._learn(list(set().union(*filter(None, split)).difference(self.known)))
        get = self.known.__getitem__
        for text, pieces in zip(texts, split, strict=True):
            try:
                yield self._whole(text) if pieces is None else b"".join(map(get, pieces))
            except TypeError:  # an odd piece, which is False
                yield self._whole(text)


_encoders: dict[str, Encoder] = {}


def _encoder(file: str) -> Encoder:
    """The process's encoder for a file, with what it has learned in earlier tasks."""
    caches.claim("encoder")
    if file not in _encoders:
        _encoders[file] = Encoder(file)
    return _encoders[file]


caches.register("encoder", _encoders.clear)


# --- files ------------------------------------------------------------------------------------------


def _open(path: str):
    fs, inner = pafs.FileSystem.from_uri(path)
    return fs, inner.rstrip("/")


def _shard_writer(folder: str, tokenizer: str, end_id: int):
    def run(batches):
        encoder = None
        keys, nulls, counts = [], [], []
        name = uuid.uuid4().hex
        fs = sink = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                encoder = _encoder(tokenizer)
                end = np.array([end_id], dtype=encoder.dtype).tobytes()
                fs, inner = _open(folder)
                sink = fs.open_output_stream(f"{inner}/shard-{name}.ids")
                sink.write(MAGIC + struct.pack("<II", encoder.width, 0))
            ids = batch["id"]
            keys.append(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            nulls.append(ids.is_null().to_numpy(zero_copy_only=False))
            waiting, size = [], 0
            for start in range(0, batch.num_rows, 256):
                for raw in encoder.encode(["" if t is None else t for t in batch["text"].slice(start, 256).to_pylist()]):
                    waiting += (raw, end)
                    counts.append(len(raw) // encoder.width + 1)
                    size += len(raw)
                    if size > _FLUSH:
                        sink.write(b"".join(waiting))
                        waiting, size = [], 0
            sink.write(b"".join(waiting))
        if sink is not None:
            key, null, n = np.concatenate(keys), np.concatenate(nulls), np.array(counts, dtype="<u8")
            sink.write(key.astype("<i8").tobytes() + null.astype("u1").tobytes() + n.tobytes())
            sink.write(struct.pack("<QQ", len(n), int(n.sum())) + MAGIC)
            sink.close()
            at = TaskContext.get().partitionId()  # partitions are ranges of keys in ascending order
            yield pa.RecordBatch.from_pydict({"at": [at], "name": [name], "n_null": [int(null.sum())], "n_docs": [len(n)], "n_ids": [int(n.sum())], "width": [encoder.width]})

    return run


def _records(fs, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, key is null, number of ids) of a shard's records."""
    with fs.open_input_file(path) as f:
        size = f.size()
        n, _ = struct.unpack("<QQ", f.read_at(_TAIL, size - _TAIL)[:16])
        raw = f.read_at(n * 17, size - _TAIL - n * 17)
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "u1", n, n * 8).astype(bool), np.frombuffer(raw, "<u8", n, n * 9)


# --- minimal perfect hashing ------------------------------------------------------------------------


def mix64(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijective mix of 64-bit keys."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


class PerfectHash:
    """n distinct 64-bit keys -> 0 .. n-1. A level is a bit array with a bit set where exactly one remaining key falls."""

    def __init__(self, levels: list[np.ndarray]):
        """levels: of each the sizes and bits as bool arrays; ranks are counted over all of them in turn."""
        self.levels = levels
        self.ranks, total = [], 0
        for bits in levels:
            below = np.cumsum(bits) - bits + total
            self.ranks.append(below.astype(np.int64))
            total += int(bits.sum())
        self.n = total

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.7) -> "PerfectHash":
        left, levels = keys.astype(np.uint64), []
        while len(left):
            size = max(1, int(gamma * len(left)) | 1)
            place = (mix64(left, len(levels)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            left = left[~alone[place]]
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
        return cls(levels)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some that are not in the set, any slot for the others of those."""
        keys = keys.astype(np.uint64)
        out, open_ = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(open_):
                break
            place = (mix64(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[place]
            out[open_[hit]] = self.ranks[level][place[hit]]
            open_ = open_[~hit]
        return out


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.astype(np.uint64), 0xF1) >> np.uint64(32)).astype(np.uint32)


#: What an index file holds of each key besides its fingerprint.
_FIELDS = (("shard", np.uint32), ("record", np.uint32), ("first", np.uint64), ("n", np.uint64), ("records", np.uint64))


def _index_writer(folder: str):
    def run(group: pa.Table) -> pa.Table:
        t = {c: group[c].to_numpy() for c in ("key", "shard", "record", "first", "n", "records")}
        order = np.lexsort((t["shard"], t["key"]))
        t = {c: x[order] for c, x in t.items()}
        begin = np.flatnonzero(np.concatenate([[True], t["key"][1:] != t["key"][:-1]]))
        records = np.add.reduceat(t["records"], begin)  # a key of many records may lie in several shards
        t = {c: x[begin] for c, x in t.items()} | {"records": records}
        keys = t["key"].view(np.uint64)
        hash_ = PerfectHash.build(keys)
        slot, bucket = hash_.find(keys), int(group["bucket"][0].as_py())
        arrays = {"sizes": np.array([len(x) for x in hash_.levels], dtype=np.uint64), "bits": np.packbits(np.concatenate(hash_.levels)), "print": np.empty(len(keys), np.uint32)}
        arrays["print"][slot] = fingerprint(keys)
        for name, kind in _FIELDS:
            arrays[name] = np.empty(len(keys), kind)
            arrays[name][slot] = t[name]
        name, raw = uuid.uuid4().hex, io.BytesIO()
        np.savez(raw, **arrays)
        fs, inner = _open(folder)
        with fs.open_output_stream(f"{inner}/index-{name}.mph") as sink:
            sink.write(INDEX_MAGIC + raw.getvalue())
        return pa.table({"bucket": pa.array([bucket], pa.int64()), "name": [name]})

    return run


class Shard(NamedTuple):
    name: str
    n_ids: int
    start: int  # ids of all shards before
    n_docs: int
    n_null: int


class TokenStore:
    """Keyed and sequential access to a store that `write_store` made."""

    def __init__(self, folder: str):
        self.folder = folder
        self.fs, self.inner = _open(folder)
        with self.fs.open_input_file(f"{self.inner}/manifest.json") as f:
            manifest = json.loads(f.read())
        self.n_shards, self.null_shards, self.buckets, self.width = (manifest[x] for x in ("shards", "null_shards", "buckets", "width"))
        self._index: dict[int, tuple | None] = {}
        self._own: dict[int, tuple] = {}
        self.loads = 0  # index files read

    def _entry(self, table: str, at: int, size: int) -> bytes:
        with self.fs.open_input_file(f"{self.inner}/{table}.tab") as f:
            return f.read_at(size, at * size)

    def shard(self, number: int) -> Shard:
        name, *numbers = _SHARD.unpack(self._entry("shards", number, _SHARD.size))
        return Shard(name.decode(), *numbers)

    def _bucket(self, bucket: int):
        if bucket not in self._index:
            name, found = self._entry("index", bucket, 32).decode(), None
            if name.strip():
                with self.fs.open_input_file(f"{self.inner}/index-{name}.mph") as f:
                    a = dict(np.load(io.BytesIO(f.read()[len(INDEX_MAGIC) :])))
                ends = np.cumsum(a["sizes"].astype(np.int64))
                bits = np.unpackbits(a.pop("bits"), count=int(ends[-1])).astype(bool)
                found = PerfectHash(np.split(bits, ends[:-1])), a
                self.loads += 1
            self._index = {bucket: found}  # one at a time in memory
        return self._index[bucket]

    def find(self, keys: np.ndarray) -> dict[str, np.ndarray]:
        """shard (-1: not in the store), record, first id, number of ids and records of each key."""
        keys = np.asarray(keys, dtype=np.int64)
        out = {n: np.zeros(len(keys), dtype=np.int64) for n, _ in _FIELDS} | {"shard": np.full(len(keys), -1, dtype=np.int64)}
        buckets = bucket_of(keys, self.buckets)
        for b in np.unique(buckets):
            if (found := self._bucket(int(b))) is None:
                continue
            at = np.flatnonzero(buckets == b)
            own = keys[at].view(np.uint64)
            slot = found[0].find(own)
            good = (slot >= 0) & (found[1]["print"][np.maximum(slot, 0)] == fingerprint(own))
            for name in out:
                out[name][at[good]] = found[1][name][slot[good]]
        return out

    def spans(self, keys: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(key, shard, record, records, first id, ids) of what each key has in each shard; ids are 0 for several records."""
        e = self.find(keys)
        for i in np.flatnonzero(e["shard"] >= 0).tolist():
            key, shard, record, first, n, left = int(keys[i]), *(int(e[x][i]) for x in ("shard", "record", "first", "n", "records"))
            if left == 1:
                yield key, shard, record, 1, first, n
                continue
            while left > 0 and shard < self.n_shards:
                here = min(left, self.shard(shard).n_docs - record)
                yield key, shard, record, here, first, 0
                shard, record, first, left = shard + 1, 0, 0, left - here

    def _opened(self, number: int):
        """One shard's row, file and, where asked for, record table at a time."""
        if number not in self._own:
            for _, file, _ in self._own.values():
                file.close()
            row = self.shard(number)
            self._own = {number: (row, self.fs.open_input_file(f"{self.inner}/shard-{row.name}.ids"), {})}
        return self._own[number]

    def _table(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids, first id) of each record of a shard."""
        row, _, held = self._opened(number)
        if not held:
            n = _records(self.fs, f"{self.inner}/shard-{row.name}.ids")[2].astype(np.int64)
            held["n"], held["first"] = n, np.cumsum(n) - n
        return held["n"], held["first"]

    def read(self, spans) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, place of the first id in the whole store, ids) of each record of the spans. Neighbours in a file are read at once."""
        waiting: list[tuple] = []  # key, first, n

        def flush(number: int):
            if waiting:
                row, file, _ = self._opened(number)
                low, size = waiting[0][1], sum(w[2] for w in waiting)
                ids = np.frombuffer(file.read_at(size * self.width, _HEAD + low * self.width), f"<u{self.width}")
                for key, first, n in waiting:
                    yield key, row.start + first, ids[first - low : first - low + n]
                waiting.clear()

        at = -1
        for key, shard, record, records, first, n in spans:
            if shard != at:
                yield from flush(at)
                at = shard
            if records == 1 and n:
                parts = ((first, n),)
            else:
                sizes, firsts = self._table(shard)
                parts = zip(firsts[record : record + records].tolist(), sizes[record : record + records].tolist(), strict=True)
            for begin, size in parts:
                if waiting and (begin != waiting[-1][1] + waiting[-1][2] or begin - waiting[0][1] > _AT_ONCE):
                    yield from flush(at)
                waiting.append((key, begin, size))
        yield from flush(at)

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each record of one key; empty if the key is not in the store."""
        return [ids for _, _, ids in self.read(self.spans(np.array([key], dtype=np.int64)))]

    def null_records(self, shard: int) -> Iterator[tuple[None, int, np.ndarray]]:
        """As `read`: the records without a key, which come first in a shard."""
        if n := self.shard(shard).n_null:
            yield from self.read([(None, shard, 0, n, 0, 0)])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(keys.view(np.uint64), 0xB0) % np.uint64(max(1, buckets))).astype(np.int64)


def write_store(
    docs: DataFrame, folder: str | None = None, *, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, index_bucket: int = INDEX_BUCKET
) -> str:
    """Encode every whole text and write shards, index and manifest; returns the store's folder.

    Keys are integers; records lie in ascending key order, those without a key first. Null text: as the
    empty text, which is the end id alone. A repeated key: its records lie side by side, over several
    shards if they are very many, and `get` returns them all. Empty table: a store without shards. Other
    columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or fresh_path(spark, "token-store")
    fs, inner = _open(folder)
    fs.create_dir(inner, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # the last two part the records of one key, also those of one text
    order = [F.col("id").asc_nulls_first(), "hash", "tie"]
    rows = rows.withColumn("hash", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    made = dealt.mapInArrow(_shard_writer(folder, tokenizer, end_id), "at long, name string, n_null long, n_docs long, n_ids long, width long")
    shards = sorted(made.collect(), key=lambda r: r["at"])  # a row for each shard
    buckets = max(1, -(-sum(r["n_docs"] for r in shards) // index_bucket))
    start, table = 0, io.BytesIO()
    for r in shards:
        table.write(_SHARD.pack(r["name"].encode(), r["n_ids"], start, r["n_docs"], r["n_null"]))
        start += r["n_ids"]
    names = [b" " * 32] * buckets
    if shards:
        index = _entries(spark, folder, [r["name"] for r in shards], buckets).groupBy("bucket").applyInArrow(_index_writer(folder), "bucket long, name string")
        for r in index.collect():  # a row for each index file
            names[r["bucket"]] = r["name"].encode()
    manifest = {"shards": len(shards), "null_shards": sum(r["n_null"] > 0 for r in shards), "buckets": buckets, "width": shards[0]["width"] if shards else 4}
    for file, content in (("shards.tab", table.getvalue()), ("index.tab", b"".join(names)), ("manifest.json", json.dumps(manifest).encode())):
        with fs.open_output_stream(f"{inner}/{file}") as f:
            f.write(content)
    return folder


def _entries(spark: SparkSession, folder: str, names: list[str], buckets: int) -> DataFrame:
    """An index row of each key and shard, from the shards' record tables."""

    def run(batches):
        fs, inner = _open(folder)
        for batch in batches:
            for shard, name in zip(batch["shard"].to_pylist(), batch["name"].to_pylist(), strict=True):
                key, null, n = _records(fs, f"{inner}/shard-{name}.ids")
                first, begin = np.cumsum(n) - n, np.concatenate([[True], key[1:] != key[:-1]])
                begin[1:] |= null[:-1]
                begin = np.flatnonzero(begin & ~null)
                if not len(begin):
                    continue
                records = np.diff(np.concatenate([begin, [len(key)]]))
                key = key[begin]
                columns = {"bucket": bucket_of(key, buckets), "key": key, "shard": np.full(len(key), shard), "record": begin, "first": first[begin], "n": n[begin], "records": records}
                yield pa.RecordBatch.from_pydict({c: pa.array(x.astype(np.int64)) for c, x in columns.items()})

    listed = spark.createDataFrame(list(enumerate(names)), "shard long, name string")
    return listed.repartition(len(names)).mapInArrow(run, "bucket long, key long, shard long, record long, first long, n long, records long")


def read_digests(spark: SparkSession, folder: str, keys: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each record of the distinct `keys` (one column), got through the index.

    start: ids of all records before it. ids_crc32: of the ids as little-endian unsigned 32-bit integers. A
    null among the keys stands for all records without a key. Keys that the store lacks give no row.
    """
    store = TokenStore(folder)
    columns = ("doc_id", "start", "n_tokens", "ids_crc32")

    def digests(records) -> Iterator[pa.RecordBatch]:
        rows = []
        for key, start, ids in records:
            rows.append((key, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in zip(columns, zip(*rows, strict=True), strict=True)})
                rows = []
        if rows:
            yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in zip(columns, zip(*rows, strict=True), strict=True)})

    def bucketed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"key": batch["key"], "bucket": bucket_of(batch["key"].to_numpy(), store_buckets)})

    def looked_up(group: pa.Table) -> pa.Table:
        """All keys of one bucket, by its one index file."""
        spans = list(TokenStore(folder).spans(group["key"].to_numpy()))
        names = ("key", "shard", "record", "records", "first", "n")
        return pa.table({c: pa.array(x, pa.int64()) for c, x in zip(names, zip(*spans, strict=True) if spans else [()] * 6, strict=True)})

    def by_shard(batches):
        own = TokenStore(folder)
        yield from digests(own.read(r for batch in batches for r in zip(*(batch[c].to_pylist() for c in ("key", "shard", "record", "records", "first", "n")), strict=True)))

    def without_key(batches):
        own = TokenStore(folder)
        yield from digests(r for batch in batches for shard in batch["shard"].to_pylist() for r in own.null_records(shard))

    store_buckets, schema = store.buckets, "doc_id long, start long, n_tokens long, ids_crc32 long"
    distinct = keys.select(F.col(keys.columns[0]).cast("long").alias("key")).filter("key IS NOT NULL").distinct()
    spans = distinct.mapInArrow(bucketed, "key long, bucket long").groupBy("bucket").applyInArrow(looked_up, "key long, shard long, record long, records long, first long, n long")
    # the ids are many times the keys: as many tasks as shards
    spans = spans.repartition(max(1, store.n_shards), "shard").sortWithinPartitions("shard", "record")
    found = spans.mapInArrow(by_shard, schema)
    if store.null_shards:
        asked = keys.filter(F.col(keys.columns[0]).isNull()).limit(1).count()
        listed = spark.range(store.null_shards if asked else 0).withColumnRenamed("id", "shard").repartition(max(1, store.null_shards), "shard")
        found = found.unionByName(listed.mapInArrow(without_key, schema))
    return found


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read_columns

    docs = read_columns(spark, sf_dir, "documents", "doc_id", "text")
    folder = write_store(docs, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    return read_digests(spark, folder, docs.select("doc_id"))
