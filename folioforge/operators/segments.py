"""The search index as segments: a base, deltas and tombstones, merged by level.

A segment is a folder of two Parquet tables, `documents` (item_id, title, metadata) and `postings`, and holds
the items of one refresh. An item of the ids that a refresh names is taken from the newest segment that
names it; one that has no document there any more is gone. A refresh of k items reads and writes k items,
whatever the index holds. Which segments an index has, in which order, is a manifest: a small Parquet table
that is written under a new number, so that a reader sees the old index or the new one. A refresh that is
lost half-way leaves a folder that no manifest names.

Segments of about one size are merged into one, so that a search opens few and an item is rewritten as often
as sizes have steps.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators.search import about_postings, bucket_of, counted_tokens, in_buckets, postings_of, terms

#: Fields by weight: title A, metadata B, body and translation C.
FIELDS = {"title": "A", "metadata": "B", "body": "C", "translation": "D"}
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.2}
BOOSTS = {"title": 1.0, "metadata": 0.4}
#: So many segments of one level become one of the next, which is of so many times the size.
FAN = 4
DOCUMENTS = "item_id long, title string, metadata string"
NAMED = "item_id long"
POSTINGS = "item_id long, token string, field string, n long, first long, bucket int"
MANIFEST = "place int, name string, items long, level int"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def built(documents: DataFrame) -> DataFrame:
    """The postings of documents (item_id, title, metadata, body, translation); a null field has none."""
    return counted_tokens(documents, {w: F.col(f) for f, w in FIELDS.items()}).withColumn("bucket", bucket_of(F.col("token")))


class Index:
    """An index of items in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        fs, p = _fs(self.spark, f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        names = [s.getPath() for s in fs.listStatus(p) if s.isDirectory()]
        done = [q.getName() for q in names if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(q, "_SUCCESS"))]
        return sorted(int(x.removeprefix("v")) for x in done)

    def manifest(self) -> list[tuple[str, int, int]]:
        """(name, items, level) of the segments, oldest first."""
        versions = self._versions()
        if not versions:
            return []
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/v{versions[-1]}").orderBy("place").collect()  # a row a segment
        return [(r.name, r.items, r.level) for r in rows]

    def _commit(self, segments: list[tuple[str, int, int]]) -> None:
        """The next manifest; a second writer of one number fails, and leaves the first one's as it is."""
        number = (self._versions() or [0])[-1] + 1
        rows = [(i, *s) for i, s in enumerate(segments)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/v{number}")

    def _read(self, name: str, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/segments/{name}/{part}")

    def _name(self, ids: DataFrame) -> str:
        """A new segment's name, with the ids that it names written."""
        name = uuid.uuid4().hex
        ids.select("item_id").distinct().write.parquet(f"{self.path}/segments/{name}/named")
        return name

    def _write(self, named: DataFrame | str, documents: DataFrame, postings: DataFrame, about: int = 0) -> tuple[str, int]:
        name = named if isinstance(named, str) else self._name(named)
        folder = f"{self.path}/segments/{name}"
        documents.select("item_id", "title", "metadata").write.parquet(f"{folder}/documents")
        in_buckets(postings, about).select(*[c.split()[0] for c in POSTINGS.split(", ")]).write.parquet(f"{folder}/postings")
        return name, self._read(name, "named", NAMED).count()

    def refresh(self, documents: DataFrame, ids: DataFrame) -> str | None:
        """A new segment for the ids (item_id; repeats, nulls and unknown ones allowed): their rows of documents (item_id, title, metadata, body, translation), and tombstones for those without one.

        The documents of other ids are not looked at. Of an id that several documents have, one is an error
        of the caller's. No id: no segment. The segment's name.
        """
        name = self._name(ids.filter("item_id IS NOT NULL"))
        # joined as they are written: by their files' size few ids are broadcast, and no text is shuffled to be met with them
        own = documents.join(self._read(name, "named", NAMED), "item_id", "left_semi")
        name, n = self._write(name, own, built(own), about_postings(own, ["body"]))
        if not n:
            return None
        self._commit([*self.manifest(), (name, n, 0)])
        return name

    def _newest(self, part: str, schema: str, segments: list[tuple[str, int, int]] | None = None) -> DataFrame:
        """The rows of all segments that no newer segment names anew.

        A segment's rows are met with the ids that newer segments name, each of which is as small as its
        refresh was; the base, which is the oldest, is never one of them.
        """
        segments = self.manifest() if segments is None else segments
        out = self.spark.createDataFrame([], schema)
        later: DataFrame | None = None
        for name, _, _ in reversed(segments):
            rows = self._read(name, part, schema)
            out = out.unionByName(rows if later is None else rows.join(later, "item_id", "left_anti"))
            named = self._read(name, "named", NAMED)
            later = named if later is None else later.unionByName(named)
        return out

    def documents(self) -> DataFrame:
        return self._newest("documents", DOCUMENTS)

    def postings(self, wanted: list[str] | None = None) -> DataFrame:
        """The postings, of some tokens: the filter reaches each segment's scan, before newer ids are taken off."""
        rows = self._newest("postings", POSTINGS)
        return rows if wanted is None else postings_of(rows, wanted)

    def compact(self, fan: int = FAN) -> int:
        """Merge runs of `fan` or more neighbours of one level into one of the next; the number of segments left.

        A merged segment names what its parts named, and keeps tombstones unless it is the oldest.
        """
        segments = self.manifest()
        while run := _run(segments, fan):
            a, b = run
            parts = segments[a:b]
            named = self._read(parts[0][0], "named", NAMED)
            for name, _, _ in parts[1:]:
                named = named.unionByName(self._read(name, "named", NAMED))
            documents = self._newest("documents", DOCUMENTS, parts)
            kept = documents if not a else named  # below the oldest there is nothing to take off
            about = sum(self._read(name, "postings", POSTINGS).count() for name, _, _ in parts)
            name, n = self._write(kept, documents, self._newest("postings", POSTINGS, parts), about)
            segments = [*segments[:a], (name, n, parts[0][2] + 1), *segments[b:]]
            self._commit(segments)
        return len(segments)

    def remove_unused(self) -> int:
        """Delete segments that the newest manifest does not name, and older manifests; to be called when nobody reads them. The number deleted."""
        fs, p = _fs(self.spark, f"{self.path}/segments")
        used = {name for name, _, _ in self.manifest()}
        gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in used] if fs.exists(p) else []
        for old in self._versions()[:-1]:
            gone.append(_fs(self.spark, f"{self.path}/manifest/v{old}")[1])
        for q in gone:
            fs.delete(q, True)
        return len(gone)

    def search(self, query: str) -> DataFrame:
        """(item_id, title, relevance) of the items that match every term: as a token of any field, or as a substring of title or metadata.

        A blank query matches all, one that is too long or has no term nothing.
        """
        wanted, documents = terms(query), self.documents()
        if not wanted:
            rows = documents if wanted is None else documents.filter(F.lit(False))
            return rows.select("item_id", "title", F.lit(0.0).alias("relevance"))
        counts = [F.count_if(F.col("field") == f).alias(f"__{f}") for f in WEIGHTS]
        found = self.postings(wanted).groupBy("item_id").agg(F.collect_set("token").alias("__tokens"), *counts)
        inside = {(f, t): F.coalesce(F.contains(F.lower(f), F.lit(t)), F.lit(False)) for f in BOOSTS for t in wanted}
        every, rank = F.lit(True), F.lit(0.0)
        for t in wanted:
            every &= F.coalesce(F.array_contains("__tokens", t), F.lit(False)) | inside["title", t] | inside["metadata", t]
        for f, weight in WEIGHTS.items():  # a field has one posting a token: as many as terms are all of them
            rank += F.when(F.col(f"__{f}") == len(wanted), weight).otherwise(0.0)
        for f, weight in BOOSTS.items():
            some = F.lit(False)
            for t in wanted:
                some |= inside[f, t]
            rank += F.when(some, weight).otherwise(0.0)
        rows = documents.join(found, "item_id", "left").filter(every)
        return rows.select("item_id", "title", F.round(rank, 6).alias("relevance"))


def _run(segments: list[tuple[str, int, int]], fan: int) -> tuple[int, int] | None:
    """(start, end) of the first `fan` or more neighbours of one level."""
    a = 0
    for b in range(1, len(segments) + 1):
        if b == len(segments) or segments[b][2] != segments[a][2]:
            if b - a >= max(2, fan):
                return a, b
            a = b
    return None
