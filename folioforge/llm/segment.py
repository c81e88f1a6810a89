"""N-best segmentation over a SentencePiece vocabulary.

A text's lattice has a node before each character and an edge for each piece; a character that no piece
holds is one edge of byte pieces. Forward Viterbi scores are exact estimates of what is left of a path
that a search from the end builds, so that A-star takes complete paths from its heap in order of score.
The forward pass goes over many parts at a time and keeps the second-best score of each node beside the best: that
gives each part its first path and what the second costs. A-star takes the further paths, and both where the first two score alike.

No piece spans a word's end or a line feed, nor steps from a word to the punctuation after it: the lattice
is a chain of parts that only share nodes. Parts are searched once and kept; a document's n best segmentations differ from its best one in those n - 1
parts at most whose second-best paths cost least, and only these are combined.

The vocabulary's own scores are merge ranks. As scores of pieces serve log-probabilities of a
Zipf-Mandelbrot law over the ranks, in whole millionths, so that sums and comparisons are exact.
"""

from __future__ import annotations

import gc
import heapq
import itertools
import math
import re
import string
import sys
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import caches
from .common import small_batches, unused, whole

N_BEST = 4
#: Shift of ranks in the law.
SHIFT = 10.0
UNIT = 1_000_000
#: Parts of each of two generations that are kept.
_CACHE = 130_000
_LONG = 64
_NEVER = 1 << 62
#: Parts that one forward pass takes, and characters of texts whose parts are met together.
_PASS = 2048
_MET = 500_000


class Segmenter:
    """Searches over one vocabulary file; pieces hold a space where the file has U+2581."""

    def __init__(self, file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=file)
        size = model.get_piece_size()
        self.bytes: dict[int, int] = {}
        self.pieces: dict[str, int] = {}
        self.raw: list[bytes] = [b""] * size
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.pieces[piece.replace("▁", " ")] = i
                self.raw[i] = piece.replace("▁", " ").encode("utf-8")
        if len(self.bytes) < 256:
            raise ValueError("the vocabulary has no byte pieces")
        if any("\n" in p or " " in p.lstrip(" ") for p in self.pieces):
            raise ValueError("a piece spans the end of a word")
        self.code = "H" if size <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        norm = math.log(sum(1.0 / (r + SHIFT) for r in range(1, len(self.pieces) + 2)))
        law = lambda rank: -round(UNIT * (math.log(rank + SHIFT) + norm))
        #: piece -> (score, ids), and the same as a tree of [next by character, value or None]
        self.scores: dict[str, tuple[int, tuple[int]]] = {}
        self.tree: list = [{}, None]
        for rank, (piece, i) in enumerate(sorted(self.pieces.items(), key=lambda x: x[1]), 1):
            node = self.tree
            for ch in piece:
                node = node[0].setdefault(ch, [{}, None])
            node[1] = self.scores[piece] = (law(rank), (i,))
        self.byte_score = law(len(self.pieces) + 1)
        self.known: dict[str, tuple[bytes, int, int]] = {}
        self.older: dict[str, tuple[bytes, int, int]] = {}
        self.parts = self._parts()
        self._arrays()
        self.sizes = np.array([len(r) for r in self.raw], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(self.raw), np.uint8)

    def _parts(self) -> re.Pattern:
        """Parts of a text: a part begins at spaces, at and after a line feed, and at punctuation that no piece has right after a letter."""
        letter = "[^\\W\\d_]"
        after = {p[i] for p in self.pieces for i in range(1, len(p)) if re.match(letter, p[i - 1])}
        marks = "".join(re.escape(m) for m in sorted(set(string.punctuation) - after))
        if not marks:
            return re.compile(" *[^ \n]+|\n| +")
        return re.compile(f" *{letter}+(?![^{marks} \n])| *[^ \n]+?(?:(?<={letter})(?=[{marks}])|(?![^ \n]))|\n| +")

    def _arrays(self) -> None:
        """The tree as arrays: characters by code point, steps as sorted keys, scores and ids by node. Node 0 is none, node 1 the root, character 0 in no piece."""
        letters = {ch: k for k, ch in enumerate(sorted({ch for p in self.pieces for ch in p}), 1)}
        self.letters = np.zeros(sys.maxunicode + 1, np.int32)
        self.letters[[ord(ch) for ch in letters]] = list(letters.values())
        self.width = len(letters) + 1
        nodes: dict[str, int] = {"": 1}
        steps: dict[int, int] = {}
        for piece in self.pieces:
            for end in range(1, len(piece) + 1):
                if piece[:end] not in nodes:
                    nodes[piece[:end]] = len(nodes) + 1
                    steps[nodes[piece[: end - 1]] * self.width + letters[piece[end - 1]]] = nodes[piece[:end]]
        self.keys = np.array(sorted(steps), np.int64)
        self.next = np.array([steps[k] for k in self.keys.tolist()], np.int64)
        self.node_score, self.node_id = np.full(len(nodes) + 1, -_NEVER // 2, np.int64), np.full(len(nodes) + 1, -1, np.int64)
        for piece, (score, (i,)) in self.scores.items():
            self.node_score[nodes[piece]], self.node_id[nodes[piece]] = score, i
        self.depth = max(map(len, self.pieces), default=1)

    # --- many parts ---

    def forward(self, parts: list[str]) -> tuple[list[bytes | None], list[int], list[int]]:
        """Raw ids of the best path, its score and what the second-best path costs (_NEVER: there is none), of each part.

        Instead of ids None where the first two paths score alike or the best one has byte pieces: A-star takes these.
        """
        count, low = len(parts), -_NEVER // 2
        sizes = np.fromiter(map(len, parts), np.int64, count)
        longest = int(sizes.max())
        code = np.zeros((count, longest), np.int64)
        code[np.arange(longest) < sizes[:, None]] = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.ascontiguousarray(code.T)  # by place, then part
        letter = self.letters[code].ravel()
        depth = min(self.depth, longest)
        # score and id of the edge by length, start and part; at length 1 bytes where no piece is the one character
        edge, piece = np.full((depth, longest * count), low, np.int64), np.full((depth, longest * count), -1, np.int64)
        at, node = np.arange(longest * count), np.ones(longest * count, np.int64)
        for d in range(depth):
            if d:
                inside = at + d * count < len(letter)
                at, node = at[inside], node[inside]
            key = node * self.width + letter[at + d * count]
            found = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[found] == key
            at, node = at[known], self.next[found[known]]
            edge[d, at], piece[d, at] = self.node_score[node], self.node_id[node]
        code = code.ravel()
        alone = piece[0] < 0
        edge[0, alone] = self.byte_score * (1 + (code[alone] > 0x7F) + (code[alone] > 0x7FF) + (code[alone] > 0xFFFF))
        edge, piece = edge.reshape(depth, longest, count), piece.reshape(depth, longest, count)
        best, second = np.full((longest + 1, count), low, np.int64), np.full((longest + 1, count), low, np.int64)
        back = np.zeros((longest + 1, count), np.int64)
        best[0] = 0
        for end in range(1, longest + 1):
            first, other, length = best[end], second[end], back[end]
            for d in range(min(depth, end)):
                start = end - d - 1
                value = best[start] + edge[d, start]
                np.maximum(other, np.minimum(first, value), out=other)
                np.maximum(other, second[start] + edge[d, start], out=other)
                length[value > first] = d + 1
                np.maximum(first, value, out=first)
        own = np.arange(count)
        score, margin = best[sizes, own], best[sizes, own] - second[sizes, own]
        margin[second[sizes, own] <= low // 2] = _NEVER
        # back along the best paths, all parts a step at a time; ids are filled from the right
        ids, used, place = np.zeros((count, longest), self.dtype), np.zeros(count, np.int64), sizes.copy()
        plain = margin > 0
        while (left := np.flatnonzero(place)).size:
            length = back[place[left], left]
            place[left] -= length
            i = piece[length - 1, place[left], left]
            plain[left[i < 0]] = False
            used[left] += 1
            ids[left, longest - used[left]] = np.maximum(i, 0)
        raw = ids[np.arange(longest) >= longest - used[:, None]].tobytes()
        ends = (np.cumsum(used) * self.dtype.itemsize).tolist()
        out = [raw[a:b] if good else None for a, b, good in zip([0, *ends], ends, plain.tolist(), strict=False)]
        return out, score.tolist(), margin.tolist()

    def meet(self, parts: Iterable[str]) -> None:
        """Learn those of the parts that are not known, many in one forward pass; long ones are left to be searched alone."""
        fresh = []
        for part in parts:
            if part not in self.known:
                if (found := self.older.get(part)) is not None:
                    self._keep(part, found)
                elif len(part) <= _LONG:
                    fresh.append(part)
        fresh.sort(key=len)
        for start in range(0, len(fresh), _PASS):
            some = fresh[start : start + _PASS]
            for part, *found in zip(some, *self.forward(some), strict=True):
                if found[0] is None:
                    self._learn(part)
                else:
                    self._keep(part, tuple(found))

    def _keep(self, part: str, found: tuple[bytes, int, int]) -> None:
        if len(self.known) >= _CACHE:
            self.older, self.known = self.known, {}
        self.known[part] = found

    # --- one part ---

    def lattice(self, part: str) -> tuple[list[list[tuple[int, tuple[int, tuple[int, ...]]]]], list[int]]:
        """Edges into each node as (start, (score, ids)), and the best score from the start to each node."""
        n, first = len(part), self.tree[0].get
        into: list[list] = [[] for _ in range(n + 1)]
        best = [-_NEVER] * (n + 1)
        best[0] = 0
        for i in range(n):
            here, end = best[i], i + 1
            node = first(part[i])
            if node is None or node[1] is None:  # no piece is the one character
                ids = tuple([self.bytes[b] for b in part[i].encode("utf-8", "surrogatepass")])
                value = (self.byte_score * len(ids), ids)
                into[end].append((i, value))
                if here + value[0] > best[end]:
                    best[end] = here + value[0]
            while node is not None:
                value = node[1]
                if value is not None:
                    into[end].append((i, value))
                    total = here + value[0]
                    if total > best[end]:
                        best[end] = total
                if end == n:
                    break
                node = node[0].get(part[end])
                end += 1
        return into, best

    def paths(self, part: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The n best (score, ids) of a part, best first; fewer if there are not as many."""
        into, best = self.lattice(part)
        # cost with the estimate, order of entry, node, cost so far, ids from the node on as a linked list
        heap, order, out = [(-best[-1], 0, len(part), 0, None)], 0, []
        push, pop = heapq.heappush, heapq.heappop
        while heap and len(out) < n:
            cost, _, node, so_far, tail = pop(heap)
            if not node:
                ids = []
                while tail is not None:
                    ids += tail[0]
                    tail = tail[1]
                out.append((-cost, tuple(ids)))
                continue
            for start, (edge, ids) in into[node]:
                order += 1
                push(heap, (so_far - edge - best[start], order, start, so_far - edge, (ids, tail)))
        return out

    def _learn(self, part: str) -> tuple[bytes, int, int]:
        """(raw ids, score, what the second-best path costs) of a part; what is met again outlives a generation."""
        found = self.older.get(part)
        if found is None:
            two = self.paths(part, 2)
            found = (array(self.code, two[0][1]).tobytes(), two[0][0], two[0][0] - two[1][0] if len(two) > 1 else _NEVER)
        if len(part) <= _LONG:
            self._keep(part, found)
        return found

    # --- whole texts ---

    def n_best(self, text: str | None, n: int = N_BEST) -> list[tuple[int, bytes]]:
        """The n best (score in millionths, raw ids) of a whole text; the empty text has one, without ids."""
        return next(self.n_best_of([text], n))

    def n_best_of(self, texts: Iterable[str | None], n: int = N_BEST) -> Iterator[list[tuple[int, bytes]]]:
        """`n_best` of each text; parts that are new in some texts are met together."""
        some, size = [], 0
        for text in itertools.chain(texts, [...]):  # the mark ends the last ones
            if text is ... or size + len(text or "") > _MET:
                self.meet(set(itertools.chain.from_iterable(some)))
                yield from (self._n_best(parts, n) for parts in some)
                some, size = [], 0
            if text is not ...:
                some.append(self.parts.findall(" " + text) if text else [])
                size += len(text or "")

    def _n_best(self, parts: list[str], n: int) -> list[tuple[int, bytes]]:
        if not parts:
            return [(0, b"")]
        get = self.known.get
        found = [get(p) or self._learn(p) for p in parts]
        score = sum([f[1] for f in found])
        ids = [f[0] for f in found]
        out = [(score, b"".join(ids))]
        if n == 1:
            return out
        near = [x for x in heapq.nsmallest(n - 1, zip([f[2] for f in found], range(len(found)), strict=True)) if x[0] < _NEVER]
        choices = []
        for _, at in near:
            paths = self.paths(parts[at], n)
            choices.append([(paths[0][0] - s, at, np.array(p, dtype=self.dtype).tobytes()) for s, p in paths])
        combined = [(0, ())]
        for options in choices:  # the n best of what is chosen so far, by cost
            combined = heapq.nsmallest(n, ((c + o[0], (*chosen, k)) for c, chosen in combined for k, o in enumerate(options)))
        for cost, chosen in itertools.islice(combined, 1, n):
            other = list(ids)
            for options, k in zip(choices, chosen, strict=True):
                other[options[k][1]] = options[k][2]
            out.append((score - cost, b"".join(other)))
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """UTF-8 of a text from its ids."""
        ids = ids.astype(np.int64)
        sizes = self.sizes[ids]
        at = np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes)
        return self.flat[at + np.arange(len(at))].tobytes()[1:]

    def decode(self, raw: bytes) -> str:
        return self.decode_bytes(np.frombuffer(raw, self.dtype)).decode("utf-8", "surrogatepass")


_segmenters: dict[str, Segmenter] = {}


def segmenter(file: str) -> Segmenter:
    """The process's searcher of a file, with the parts it has met."""
    caches.claim("segment")
    gc.disable()  # a search makes many small objects and no cycles; the next owner turns it on again
    if file not in _segmenters:
        _segmenters[file] = Segmenter(file)
    return _segmenters[file]


caches.register("segment", _segmenters.clear)


def segment(docs: DataFrame, *, vocabulary: str, n: int = N_BEST, text_col: str = "text", out: str = "segmentations") -> DataFrame:
    """`docs` with a column `out`: array<struct<score double, ids array<int>>>, the n best segmentations, best first.

    Whole texts are searched. Null or empty text: one segmentation without pieces. A text with
    fewer than n segmentations has them all. Equal scores come in an order that depends on the text alone.
    An input column named `out` gives way; all others are kept.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<score:double,ids:array<int>>>")
    def run(texts: pd.Series) -> pd.Series:
        own = segmenter(vocabulary)
        made = [[{"score": s / UNIT, "ids": np.frombuffer(raw, own.dtype).astype(np.int32)} for s, raw in found] for found in own.n_best_of(texts, n)]
        return pd.Series(made, index=texts.index, dtype=object)

    return docs.select(*[c for c, name in zip(whole(docs), docs.columns, strict=True) if name.lower() != out.lower()], run(F.col(text_col)).alias(out))


def digests(docs: DataFrame, *, vocabulary: str, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs` and rank: id, rank (from 1), score, n_pieces, ids_crc32, round_trip.

    ids_crc32: of the ids as little-endian unsigned 32-bit integers. round_trip: the ids decode to the
    text. Null text: as the empty text. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "rank", "score", "n_pieces", "ids_crc32", "round_trip"]

    def run(batches):
        own = segmenter(vocabulary)
        for batch in batches:
            at, rank, score, size, crc, same = [], [], [], [], [], []
            texts = (t for start in range(0, batch.num_rows, 256) for t in batch["text"].slice(start, 256).to_pylist())
            mine, searched = itertools.tee(texts)
            for i, (text, found) in enumerate(zip(mine, own.n_best_of(searched, n), strict=True)):
                plain = (text or "").encode("utf-8", "surrogatepass")
                for k, (s, raw) in enumerate(found, 1):
                    ids = np.frombuffer(raw, own.dtype)
                    at.append(i)
                    rank.append(k)
                    score.append(s / UNIT)
                    size.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                    same.append(own.decode_bytes(ids) == plain)
            columns = [batch["id"].take(pa.array(at, pa.int64())), pa.array(rank, pa.int32()), pa.array(score, pa.float64())]
            columns += [pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, rank int, score double, n_pieces long, ids_crc32 long, round_trip boolean")


def encoded_documents(docs: DataFrame, *, vocabulary: str, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns `keep`, and of each row of `docs` its best segmentation: ids, score, and margin, by how much it beats the n-th (0 if it is the only one).

    Null, empty and repeated texts and ids: as in `digests`, a row each, of no pieces where there is no text.
    Where a kept column is called ids, score or margin, the new one of that name begins with an underscore.
    Empty table: no rows.
    """
    small_batches(docs.sparkSession)
    names = [id_col, *keep]
    kept_columns = docs.select(*[F.col(f"`{c}`") for c in names])
    text, *made = unused(kept_columns, "text", "ids", "score", "margin")
    kind = {f.name: f.dataType.simpleString() for f in docs.schema}

    def run(batches):
        own = segmenter(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                found = list(own.n_best_of(batch[text].slice(start, 256).to_pylist(), n))
                ids = [np.frombuffer(f[0][1], own.dtype) for f in found]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32)))
                score = [f[0][0] / UNIT for f in found]
                margin = [(f[0][0] - f[-1][0]) / UNIT for f in found]
                kept = [batch[c].slice(start, 256) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, lists, pa.array(score, pa.float64()), pa.array(margin, pa.float64())], names=[*names, *made])

    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(text_col).alias(text))
    schema = ", ".join(f"`{c}` {kind[c]}" for c in names)
    return rows.mapInArrow(run, f"{schema}, `{made[0]}` array<int>, `{made[1]}` double, `{made[2]}` double")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read_columns

    docs = read_columns(spark, sf_dir, "documents", "doc_id", "text")
    return digests(docs, vocabulary=public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")
