"""Language identification by word-first backoff.

A known word scores its log frequency in each language. An unseen one falls back to its character
n-grams, the longest first: the mean log frequency of those that are known at the first length at which
any is. Words and n-grams are counted over a bounded sample of labelled documents, whole texts; the model
holds all words and n-grams of that sample. Only the sample is bounded: in documents, dealt evenly to the
languages so that a rare one keeps its documents beside a huge one, and by the size of the model that comes
of it, as the model is broadcast.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import caches
from .common import small_batches, stage_table, unused, whole
from .shingles import _finish

UNKNOWN = "und"
#: Bound of the training sample, in documents. Each language gives its documents of the smallest hashes, all languages equally many
#: as far as they have them. With more languages than this, one document each of as many languages, the most frequent ones.
MAX_TRAIN_DOCS = 20_000
#: Bound of the model, in counts of an n-gram in a language, 14 to 22 bytes each: where the sample has more, half as many documents are taken.
MAX_MODEL_ROWS = 4_000_000
ORDERS = (5, 4, 3, 2, 1)
#: A document is rejected below this share of the evidence.
MIN_SCORE = 0.5
SMOOTH = 0.5
#: Tokens whose evidence a worker remembers, and the bytes that they may take.
_CACHE, _CACHE_BYTES = 100_000, 48 << 20
#: Tallies that go to the JVM at a time; it holds a batch outside its heap.
_TALLIES = 1 << 15
_LETTERS = re.compile(r"[^\W\d_]+")
_BINS = 4096
_STEP, _ORDER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def grams(word: str, n: int) -> list[str]:
    """The word's n-grams with its ends marked; for n = 1 its letters."""
    if n == 1:
        return list(word)
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Keys:
    """64-bit keys of words, none of them empty, and of the n-grams of all of them at once."""

    def __init__(self, words: list[str]):
        self.points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.begins = np.cumsum(self.sizes + 2) - self.sizes - 2

    def words(self) -> np.ndarray:
        """A key of each word."""
        power = np.cumprod(np.full(int(self.sizes.max(initial=0)), _STEP, dtype=np.uint64))
        flat, owner = self._letters(np.arange(len(self.sizes)))
        place = np.arange(len(flat)) - (np.cumsum(self.sizes) - self.sizes)[owner]
        values = _finish(self.points[flat] + _ORDER) * power[place]
        total = np.add.reduceat(values, np.cumsum(self.sizes) - self.sizes) if len(values) else np.empty(0, np.uint64)
        return _finish(total + self.sizes.astype(np.uint64))

    def _letters(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.sizes[which]
        owner = np.repeat(np.arange(len(which)), n)
        return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + (self.begins[which] + 1)[owner], owner

    def grams(self, order: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the n-grams of the chosen words, and the place of each one's word among the chosen."""
        if order == 1:
            start, owner = self._letters(which)
        else:
            n = np.maximum(self.sizes[which] + 3 - order, 0)
            owner = np.repeat(np.arange(len(which)), n)
            start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.begins[which][owner]
        key = np.full(len(start), order, dtype=np.uint64)
        for k in range(order):
            key = key * _STEP + self.points[start + k]
        return _finish(key * _ORDER + np.uint64(order)), owner


def _tallies(lang: str, counts: Counter) -> Iterator[pa.RecordBatch]:
    """(lang, order, key, n) of the words, under order 0, and of their n-grams: one order at a time, in batches of _TALLIES rows."""
    keys, times = Keys(list(counts)), np.fromiter(counts.values(), np.int64, len(counts))
    for order in (0, *ORDERS):
        key, owner = keys.grams(order, np.arange(len(times))) if order else (keys.words(), slice(None))
        distinct, at = np.unique(key, return_inverse=True)
        n = np.bincount(at, times[owner], len(distinct)).astype(np.int64)
        for start in range(0, len(distinct), _TALLIES):
            part = distinct[start : start + _TALLIES].view(np.int64)
            columns = {"lang": pa.repeat(pa.scalar(lang, pa.string()), len(part)), "order": np.full(len(part), order, np.int32), "key": part, "n": n[start : start + _TALLIES]}
            yield pa.RecordBatch.from_pydict(columns)


def _counted(batches):
    """The tallies of a partition, language by language, flushed when large."""
    caches.claim("languages")
    counts: dict[str, Counter] = defaultdict(Counter)
    held = 0
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            own = counts[lang]
            held -= len(own)
            own.update(_LETTERS.findall(text.lower()))
            held += len(own)
            if held > 60_000:
                yield from (b for x, c in counts.items() if c for b in _tallies(x, c))
                counts.clear()
                held = 0
    yield from (b for x, c in counts.items() if c for b in _tallies(x, c))


class Model:
    """Log frequencies by key: sparse rows over the languages, on top of what an n-gram of the order that a language lacks has there."""

    def __init__(self, languages: list[str], priors: list[float], rows: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]):
        """rows: order (0 for words), key, number of the language and count, a row for each that is found."""
        self.id = uuid.uuid4().hex
        self.languages, self.priors = languages, np.asarray(priors, dtype=np.float64)
        order, key, lang, n = rows
        sort = np.lexsort((lang, key))
        order, key, lang, n = order[sort], key[sort], lang[sort], n[sort]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        self.keys, self.begins = key[first], np.append(first, len(key)).astype(np.int32)
        self.orders = order[first].astype(np.int8)
        totals = np.zeros((len(ORDERS) + 1, len(languages)))
        np.add.at(totals, (order, lang), n)
        distinct = np.bincount(self.orders, minlength=len(ORDERS) + 1)
        self.absent = np.log(SMOOTH / (totals + SMOOTH * (distinct[:, None] + 1)))
        self.lang = lang.astype(np.uint16 if len(languages) < 1 << 16 else np.int32)
        self.more = np.log((n + SMOOTH) / SMOOTH).astype(np.float32)

    def rows(self, keys: np.ndarray) -> np.ndarray:
        """The model's row of each key; -1 for unknown ones."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def _sums(self, order: int, owner: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Sums of the log frequencies of one order's rows by owner."""
        sizes, wide = self.begins[rows + 1] - self.begins[rows], len(self.languages)
        flat = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.begins[rows], sizes)
        more = np.bincount(np.repeat(owner, sizes) * wide + self.lang[flat], self.more[flat], n * wide).reshape(n, wide)
        return more + np.bincount(owner, minlength=n)[:, None] * self.absent[order]

    def evidence(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log frequencies by language of lower-case words of letters, and whether anything in a word is known."""
        keys = Keys(words)
        out, known = np.zeros((len(words), len(self.languages))), np.zeros(len(words), bool)
        row = self.rows(keys.words())
        at = np.flatnonzero(row >= 0)
        out[at], known[at] = self._sums(0, np.arange(len(at)), row[at], len(at)), True
        for order in ORDERS:
            left = np.flatnonzero(~known)
            if not len(left):
                break
            key, owner = keys.grams(order, left)
            row = self.rows(key)
            owner, row = owner[row >= 0], row[row >= 0]
            n = np.bincount(owner, minlength=len(left))
            some = n > 0
            out[left[some]] = (self._sums(order, owner, row, len(left)) / np.maximum(n, 1)[:, None])[some]
            known[left[some]] = True
        return out, known


class Scorer:
    """Scores texts; remembers the evidence of the tokens it has met."""

    def __init__(self, model: Model):
        self.model, self.bound = model, max(1024, min(_CACHE, _CACHE_BYTES // (8 * max(1, len(model.languages)))))
        self.rows: dict[str, int] = {}
        self.matrix, self.used = np.zeros((1024, len(model.languages))), 0

    def _learn(self, tokens: list[str]) -> None:
        """Evidence of tokens not met before: the sum of that of their words. -1: none in them is known."""
        parts = [_LETTERS.findall(t.lower()) for t in tokens]
        evidence, known = self.model.evidence([w for p in parts for w in p])
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        owner = np.repeat(np.arange(len(parts)), sizes)
        total, some = np.zeros((len(parts), len(self.model.languages))), np.zeros(len(parts), bool)
        for k in range(total.shape[1]):
            total[:, k] = np.bincount(owner[known], evidence[known, k], len(parts))
        some[owner[known]] = True
        n = int(some.sum())
        while self.used + n > len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
        place = np.full(len(parts), -1, np.int64)
        place[some] = np.arange(self.used, self.used + n)
        self.matrix[self.used : self.used + n] = total[some]
        self.used += n
        self.rows.update(zip(tokens, place.tolist(), strict=True))

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """lang_pred and score of each text."""
        model, out = self.model, []
        for text in texts:
            if not text or not model.languages or not any(map(str.isalpha, text)):
                out.append((UNKNOWN, 0.0))
                continue
            total, tokens = np.zeros(len(model.languages)), text.split()
            step = min(20_000, self.bound)
            for start in range(0, len(tokens), step):
                part = tokens[start : start + step]
                try:
                    rows = list(map(self.rows.__getitem__, part))
                except KeyError:
                    if len(self.rows) + len(part) > self.bound:
                        self.rows, self.used = {}, 0
                    self._learn(list(set(part).difference(self.rows)))
                    rows = list(map(self.rows.__getitem__, part))
                at = np.array(rows, dtype=np.int64)
                if len(at := at[at >= 0]):
                    total += self.matrix[at].sum(axis=0)
            total = (total - total.max()) / math.sqrt(len(tokens)) + model.priors
            odds = np.exp(total - total.max())
            best = int(np.argmax(odds))  # ties: the first language by name
            out.append((model.languages[best], float(odds[best] / odds.sum())))
        return out


_scorers: dict[str, Scorer] = {}
caches.register("languages", _scorers.clear)


def _scorer(model: Model) -> Scorer:
    """The process's scorer of a model, with the tokens that it has met in earlier tasks."""
    caches.claim("languages")
    if model.id not in _scorers:
        _scorers.clear()
        _scorers[model.id] = Scorer(model)
    return _scorers[model.id]


def quotas(sizes: dict[str, int], max_docs: int) -> dict[str, int]:
    """Documents of each language in a sample of `max_docs`: equally many as far as they go, what small ones lack goes to the others."""
    out, left = {}, max_docs
    order = sorted(sizes, key=lambda x: (sizes[x], x))
    if len(order) > max_docs:
        order = sorted(sorted(order, key=lambda x: (-sizes[x], x))[:max_docs], key=lambda x: (sizes[x], x))
    for k, lang in enumerate(order):
        out[lang] = min(sizes[lang], left // (len(order) - k))
        left -= out[lang]
    return out


def _hash() -> Column:
    """A row's place in the order in which its language gives rows: 60 bits, five digits of 12."""
    return F.shiftrightunsigned(F.xxhash64("id", "text"), 4)


def sample_keys(docs: DataFrame) -> DataFrame:
    """(lang, hash) of rows (id, text, lang), as a table: the texts are read once for all that chooses among them."""
    return stage_table(docs.select("lang", _hash().alias("hash")), "language-keys")


def _sizes(keys: DataFrame, most: int) -> dict[str, int]:
    """Documents of each language, of the `most` most frequent ones."""
    return {r["lang"]: r["count"] for r in keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most).collect()}


def training_sample(docs: DataFrame, max_docs: int, keys: DataFrame | None = None, sizes: dict[str, int] | None = None) -> DataFrame:
    """At most `max_docs` rows of (id, text, lang): of each language those with the smallest hashes of id and text, as many as `quotas` says.

    The hash that ends a language's part is found digit by digit, from counts of _BINS bins each. Copies of
    one row are taken all or none; where a language had nothing else to give, each row is taken once.
    """
    keys = sample_keys(docs) if keys is None else keys
    sizes = _sizes(keys, max_docs) if sizes is None else sizes
    wanted = quotas(sizes, max_docs)
    if len(sizes) < max_docs and all(wanted.get(x) == n for x, n in sizes.items()):
        return docs
    spark, copies = docs.sparkSession, False
    # of each language: rows taken so far, and the range of hashes in which its part ends
    state = {x: (0, 0) for x, n in sizes.items() if 0 < wanted.get(x, 0) < n}
    ends = {x: (1 << 60) if wanted.get(x) == n else 0 for x, n in sizes.items()}
    for shift in (48, 36, 24, 12, 0):
        if not state:
            break
        low = spark.createDataFrame([(x, s[1]) for x, s in state.items()], "lang string, low long")
        bins = keys.join(F.broadcast(low), "lang").withColumn("bin", F.shiftright(F.col("hash") - F.col("low"), shift))
        counts = defaultdict(dict)
        for r in bins.filter((F.col("bin") >= 0) & (F.col("bin") < _BINS)).groupBy("lang", "bin").count().toLocalIterator():  # _BINS rows a language at most
            counts[r["lang"]][r["bin"]] = r["count"]
        following = {}
        for x, (taken, begin) in state.items():
            for b in sorted(counts[x]):
                if taken + counts[x][b] > wanted[x]:
                    following[x] = (taken, begin + (b << shift))
                    break
                taken += counts[x][b]
            else:
                b = _BINS
            ends[x] = begin + (b << shift)
            if x in following and shift == 0 and taken == 0:
                ends[x], copies = ends[x] + 1, True  # more copies of one row than the language may give
        state = {x: s for x, s in following.items() if s[0] < wanted[x]}
    limits = spark.createDataFrame([(x, e) for x, e in ends.items() if e], "lang string, end long")
    taken = docs.select("id", "text", "lang").withColumn("hash", _hash()).join(F.broadcast(limits), "lang").filter(F.col("hash") < F.col("end"))
    return (taken.dropDuplicates(["lang", "hash"]) if copies else taken).select("id", "text", "lang")


def train(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    max_docs: int = MAX_TRAIN_DOCS, max_rows: int = MAX_MODEL_ROWS,
) -> Model:
    """A model of the rows of `docs` with id, text and language.

    `max_docs` bounds the labelled documents that are learned from, and is halved as long as the model of
    the sample has more than `max_rows` counts; a model of one document is taken whatever it has. Of the
    sample every word and n-gram is kept. Priors are the languages' shares of all labelled documents. Rows
    with a null id, text or language are not learned from. Empty table: a model without languages.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    keys = sample_keys(rows)
    sizes = _sizes(keys, max_docs)
    while True:
        sample = training_sample(rows, max_docs, keys, sizes).select("lang", "text")
        tallies = sample.mapInArrow(_counted, "lang string, order int, key long, n long").groupBy("lang", "order", "key").agg(F.sum("n").alias("n"))
        tallies = stage_table(tallies, "language-counts")
        if tallies.count() <= max_rows or max_docs == 1:
            break
        max_docs = max(1, max_docs // 2)
    languages = sorted(quotas(sizes, max_docs))
    numbers = spark.createDataFrame([(x, i) for i, x in enumerate(languages)], "lang string, number int")
    got = tallies.join(F.broadcast(numbers), "lang").select("order", "key", "number", "n").toArrow()  # max_rows at most
    order, key, number, n = (got[c].to_numpy() for c in ("order", "key", "number", "n"))
    total = sum(sizes[x] for x in languages)
    return Model(languages, [math.log(sizes[x] / total) for x in languages], (order, key.view(np.uint64), number, n))


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", out: str = "language") -> DataFrame:
    """`docs` with a struct column `out`: lang_pred and score, the language's share of the evidence (0 to 1).

    Null or empty text, one without a letter, or a model without languages: `und` and 0. A text of which
    nothing is known goes to the most frequent language. Ties go to the first language by name. Whole
    texts are scored. An input column named `out` gives way; all others are kept.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = _scorer(shared.value)
        for texts in batches:
            yield pd.DataFrame(scorer.score(texts.tolist()), columns=["lang_pred", "score"])

    return docs.select(*[c for c, name in zip(whole(docs), docs.columns, strict=True) if name.lower() != out.lower()], run(F.col(text_col)).alias(out))


def fold(id_col: str) -> Column:
    """crc32 of the id as text, mod 3; null for a null id, which neither trains nor is held out."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3


def accepted_documents(docs: DataFrame, *, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` whose language is told with at least `min_score`; learns from two thirds of the rows.

    Texts that are null, empty or without a letter are told no language and go. Rows without an id are
    judged, though not learned from; repeated rows are judged alike. Empty table: empty result. The
    columns are those of `docs`, whatever their names.
    """
    model = train(docs.filter(fold(id_col) != 1), id_col=id_col, text_col=text_col, lang_col=lang_col)
    (told,) = unused(docs, "language")
    scored = predict(docs, model, text_col=text_col, out=told)
    return scored.filter((F.col(told)["lang_pred"] != UNKNOWN) & (F.col(told)["score"] >= min_score)).select(*whole(docs))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_columns

    docs = read_columns(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = train(docs.filter(fold("doc_id") != 1))
    scored = predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "language.lang_pred", "language.score")
