"""Dictionary surfaces in texts: one automaton walk over the normal form, and places in the text as it stands.

A surface and a text are compared in one normal form: NFC, without bidirectional marks, case-folded, blanks
collapsed. That changes lengths, so a text's normal form comes with the piece of the original that each of
its characters stands for. Dictionaries are dealt in blocks of bounded size; a block's automaton is built
once per task and every text walks through it once, however many surfaces there are. Texts are walked
through many at a time, and what is told of their places is told in arrays.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from folioforge.operators.entities import BIDI, BROADCAST_SURFACES, MAX_SURFACE

#: Characters of a block's surfaces, which bound the automaton of a task; a dictionary of more is dealt in several blocks.
BLOCK_CHARS = 4_000_000
#: Characters of the texts that a task walks through at a time, a longer text alone; and places that it hands on at a time.
BATCH_CHARS = 1_000_000
BATCH_ROWS = 65_536
_NO_BIDI = dict.fromkeys(map(ord, BIDI))


def normal_text(text: str) -> str:
    """The normal form of a surface or text."""
    return " ".join(unicodedata.normalize("NFC", text).translate(_NO_BIDI).casefold().split())


@F.pandas_udf(StringType())
def normal_form(names: pd.Series) -> pd.Series:
    """`normal_text` as a column, for names; null stays."""
    return names.map(normal_text, na_action="ignore")


def _clusters(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of a text that NFC changes one by one: a piece ends where the next character neither combines with it nor moves into it."""
    start = 0
    for i in range(1, len(text)):
        c = text[i]
        if c < "\u0300":
            joins = False
        elif unicodedata.combining(c):
            joins = True
        else:  # some starters compose with what is before them
            piece = unicodedata.normalize("NFC", text[start:i])
            joins = unicodedata.normalize("NFC", text[start : i + 1]) != piece + unicodedata.normalize("NFC", c)
        if not joins:
            yield start, i
            start = i
    if text:
        yield start, len(text)


class _Characters:
    """What is known of characters by code, learned as they are met: the folded form's length and first code, whether it is a blank or part of a word."""

    def __init__(self):
        self.size = np.full(sys.maxunicode + 1, -1, np.int8)
        self.first = np.zeros(sys.maxunicode + 1, np.uint32)
        self.blank = np.zeros(sys.maxunicode + 1, bool)
        self.token = np.zeros(sys.maxunicode + 1, bool)
        self.longer: dict[int, np.ndarray] = {}

    def learn(self, codes: np.ndarray) -> None:
        for code in np.unique(codes[self.size[codes] < 0]).tolist():
            c = chr(code)
            folded = _codes(c.translate(_NO_BIDI).casefold())
            self.size[code], self.blank[code], self.token[code] = len(folded), c.isspace(), unicodedata.category(c)[0] in "LNM"
            if len(folded):
                self.first[code] = folded[0]
            if len(folded) > 1:
                self.longer[code] = folded

    def folded(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes of the folded text without marks, place of the character that each stands for)."""
        self.learn(codes)
        size = self.size[codes]
        if (size == 1).all():
            return self.first[codes], np.arange(len(codes))
        own = np.repeat(np.arange(len(codes)), size)
        out = self.first[codes][own]
        long = np.flatnonzero(size > 1)
        at = (np.cumsum(size, dtype=np.int64) - size)[long]
        for code in np.unique(codes[long]).tolist():
            here = at[codes[long] == code]
            for k, c in enumerate(self.longer[code].tolist()):
                out[here + k] = c
        return out, own


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_CHARACTERS: list[_Characters] = []


def _characters() -> _Characters:
    """One table for all texts of a process."""
    if not _CHARACTERS:
        _CHARACTERS.append(_Characters())
    return _CHARACTERS[0]


def _pieces(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of the folded text without marks, start, end) of a text that NFC changes: the piece of the original that each character stands for, -1 where that can't be told."""
    out, starts, ends = [], [], []
    for start, end in _clusters(text):
        piece = unicodedata.normalize("NFC", text[start:end]).translate(_NO_BIDI).casefold()
        out.append(piece)
        starts += [start] * len(piece)
        ends += [end] * len(piece)
    if " ".join("".join(out).split()) != (whole := normal_text(text)):
        return _codes(whole), (none := np.full(len(whole), -1, np.int64)), none
    return _codes("".join(out)), np.array(starts, np.int64), np.array(ends, np.int64)


class Spanned:
    """The normal forms of texts, one after the other, each after a line end and the last before one; a normal form has no line end.

    texts: those that NFC leaves alone come first, so this may be in another order than given; `given` tells which is which.
    codes, starts, ends: each character of the normal forms stands for a piece of `texts[k]`; a blank for its whole run.
    firsts: where the normal form of each begins, and one beyond.
    """

    def __init__(self, texts: list[str]):
        known, plain = _characters(), [unicodedata.is_normalized("NFC", t) for t in texts]
        self.given = np.array([k for k, x in enumerate(plain) if x] + [k for k, x in enumerate(plain) if not x], np.int64)
        self.texts, self.plain = [texts[k] for k in self.given.tolist()], sum(plain)
        whole = _codes("".join("\n" + t for t in self.texts[: self.plain]) + "\n")
        lengths = np.array([len(t) + 1 for t in self.texts], np.int64)
        self.bases = np.cumsum(lengths) - lengths + 1  # of each text, if all stood one after the other like the normal forms
        # a text that NFC leaves alone is folded character by character
        folded, starts = known.folded(whole)
        gaps = np.searchsorted(starts, np.append(self.bases[: self.plain] - 1, len(whole) - 1))  # a line end is one character
        ends = starts + 1
        if self.plain < len(texts):
            made, at, line_end = [[folded, starts, ends]], len(folded), _codes("\n")
            for text, base in zip(self.texts[self.plain :], self.bases[self.plain :].tolist(), strict=True):
                codes, a, b = _pieces(text)
                after = np.array([base + len(text)])
                made.append([np.concatenate(x) for x in ((codes, line_end), (np.where(a < 0, -1, a + base), after), (np.where(b < 0, -1, b + base), after + 1))])
                at += len(codes) + 1
                gaps = np.append(gaps, at - 1)
            folded, starts, ends = (np.concatenate(x) for x in zip(*made, strict=True))
        known.learn(folded)
        blank = known.blank[folded]
        gap = np.zeros(len(folded), bool)
        gap[gaps] = True
        keep = ~blank | gap
        keep[1:] |= ~blank[:-1]  # of a run of blanks the first; none after a line end
        kept = np.flatnonzero(keep)
        last = blank[kept] & ~gap[kept]
        last[:-1] &= gap[kept[1:]]
        kept = kept[~last]  # none before a line end
        single = np.flatnonzero(blank[kept] & ~gap[kept])
        self.codes, self.starts, self.ends = folded[kept], starts[kept], ends[kept]
        self.codes[single] = ord(" ")
        self.ends[single] = ends[kept[single + 1] - 1]
        self.firsts = np.flatnonzero(gap[kept]) + 1

    @property
    def normal(self) -> str:
        return self.codes.tobytes().decode("utf-32-le", "surrogatepass")


def spanned(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """(normal form, start, end): each of its characters stands for text[start:end]; a blank for its whole run."""
    x = Spanned([text])
    return x.normal[1:-1], x.starts[1:-1] - 1, x.ends[1:-1] - 1


class Places:
    """Places of surfaces in texts, as arrays.

    text, surface: their numbers. ordinal. start, end: in the text; -1 where there is no piece of the original.
    normal_start, normal_end: in its normal form. bounded: whether it stands between word bounds.
    """

    FIELDS = ("text", "surface", "ordinal", "start", "end", "normal_start", "normal_end", "bounded")

    def __init__(self, **columns: np.ndarray):
        self.__dict__ |= columns

    def take(self, which: np.ndarray) -> Places:
        return Places(**{c: getattr(self, c)[which] for c in self.FIELDS})

    def standing(self) -> Places:
        """The places that `accepted` keeps and, among those of each text, `uncovered`."""
        own = self.take(np.flatnonzero(self.bounded & (self.start >= 0)))
        if not len(own.text):
            return own
        # texts one after the other, so that what is before a place's text never reaches into it
        original, normal = (own.text * (int(x.max()) + 1) for x in (own.end, own.normal_end))
        start, end, normal_start, normal_end = original + own.start, original + own.end, normal + own.normal_start, normal + own.normal_end
        by_place, by_start = np.argsort(normal_start, kind="stable"), np.argsort(start, kind="stable")
        beyond = np.maximum.accumulate(end[by_place])[np.searchsorted(normal_start[by_place], normal_start, "right") - 1]
        before = np.searchsorted(start[by_start], start, "left") - 1
        around = np.where(before < 0, -1, np.maximum.accumulate(normal_end[by_start])[before])
        return own.take(np.flatnonzero((beyond <= end) & (around < normal_end)))


class Automaton:
    """All surfaces of a block in one automaton, and their non-overlapping places in texts."""

    def __init__(self, surfaces: list[str]):
        import ahocorasick

        self.surfaces = [s for s in dict.fromkeys(surfaces) if s]
        self.sizes = np.array([len(s) for s in self.surfaces], np.int64)
        self.stripped = np.array([s == s.strip() for s in self.surfaces], bool)
        self.number = np.uint16 if len(self.surfaces) <= 1 << 16 else np.int32  # small ones are sorted faster
        self.walker = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, s in enumerate(self.surfaces):
            self.walker.add_word(s, k)
        if self.surfaces:
            self.walker.make_automaton()

    def places(self, texts: list[str], exact: bool = True) -> Places:
        """The places of each surface in each text from left to right, of which none overlaps the one before; all texts are walked through as one.

        Ordinals count the places of a surface from 1, whether or not they stand between word bounds. Where
        a piece of the original does not have the surface as its normal form, that surface has places without
        start and end in this text; unless `exact` is false: then each place has the piece that
        its characters stand for, "ße" for "se".
        """
        if not self.surfaces or not texts:
            return Places(**dict.fromkeys(Places.FIELDS[:-1], np.zeros(0, np.int64)), bounded=np.zeros(0, bool))
        own = Spanned(texts)
        met = np.fromiter(chain.from_iterable(self.walker.iter(own.normal)), np.int64).reshape(-1, 2)
        text = np.searchsorted(own.firsts, met[:, 0], "right") - 1
        order = np.argsort(met[:, 1].astype(self.number), kind="stable")
        text, surface = text[order], met[order, 1]
        size = self.sizes[surface]
        at = met[order, 0] + 1 - size

        new = np.ones(len(at), bool)  # the first place of its surface in its text
        new[1:] = (surface[1:] != surface[:-1]) | (text[1:] != text[:-1])
        near = np.flatnonzero(~new & (np.diff(at, prepend=0) < size))
        if len(near):
            free = np.ones(len(at), bool)
            last = seen = -1
            for i, p, n, previous in zip(near.tolist(), at[near].tolist(), size[near].tolist(), at[near - 1].tolist(), strict=True):
                last = last if seen == i - 1 else previous
                if p < last + n:
                    free[i] = False
                else:
                    last = p
                seen = i
            text, surface, size, at, new = (x[free] for x in (text, surface, size, at, new))
        group = np.cumsum(new) - 1
        ordinal = np.arange(len(at)) - np.flatnonzero(new)[group] + 1

        end_at = at + size
        start, end, base = own.starts[at], own.ends[end_at - 1], own.bases[text]
        none = start < 0
        if exact:
            odd = (start == own.starts[at - 1]) | (own.starts[end_at - 1] == own.starts[end_at]) | ~self.stripped[surface]
            for i in np.flatnonzero((text >= own.plain) & ~none).tolist():
                t, b = own.texts[text[i]], base[i]
                odd[i] = normal_text(t[start[i] - b : end[i] - b]) != self.surfaces[surface[i]]
            apart = np.zeros(int(group[-1]) + 1 if len(group) else 0, bool)
            apart[group[odd]] = True
            none = none | apart[group]
        token = _characters().token[own.codes]
        return Places(
            text=own.given[text], surface=surface, ordinal=ordinal, start=np.where(none, -1, start - base), end=np.where(none, -1, end - base),
            normal_start=at - own.firsts[text], normal_end=end_at - own.firsts[text], bounded=~(token[at - 1] | token[end_at]),
        )

    def occurrences(self, text: str, exact: bool = True) -> Iterator[tuple]:
        """(surface, ordinal, start, end, normal_start, normal_end, matched_text, bounded) of one text, see `places`."""
        x = self.places([text], exact)
        for k in range(len(x.text)):
            a, b = (int(x.start[k]), int(x.end[k])) if x.start[k] >= 0 else (None, None)
            yield self.surfaces[x.surface[k]], int(x.ordinal[k]), a, b, int(x.normal_start[k]), int(x.normal_end[k]), None if a is None else text[a:b], bool(x.bounded[k])


FIELDS = "surface string, ordinal int, start int, end int, normal_start int, normal_end int, matched_text string, bounded boolean"


def _slices(texts: pa.Array, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """texts[text][start:end] as strings, null where start is -1."""
    data, offsets = np.frombuffer(texts.buffers()[2] or b"", np.uint8), np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    begins = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # of the characters
    base = np.searchsorted(begins, offsets[:-1])[text]
    none = start < 0
    a, b = begins[np.where(none, 0, base + start)], begins[np.where(none, 0, base + end)]
    ends = np.cumsum(b - a)
    values = data[np.arange(ends[-1]) + np.repeat(a - (ends - (b - a)), b - a)]
    made = pa.StringArray.from_buffers(len(text), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(values))
    return pc.if_else(pa.array(~none), made, pa.scalar(None, pa.string())) if none.any() else made


def _shares(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch's rows with a text in shares of about BATCH_CHARS characters."""
    size = pc.utf8_length(batch["text"])
    batch = batch.filter(pc.greater(size, 0))
    share = np.cumsum(pc.utf8_length(batch["text"]).to_numpy(zero_copy_only=False)) // BATCH_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def _walk(surfaces: list[str], exact: bool, standing: bool):
    def run(batches):
        own = Automaton(surfaces)
        shown = pa.array(own.surfaces, pa.string())
        for whole in batches:
            for batch in _shares(whole):
                texts = batch["text"].cast(pa.string())
                x = own.places(texts.to_pylist(), exact)
                x = x.standing() if standing else x
                if not len(x.text):
                    continue
                none = x.start < 0
                columns = {
                    "item_id": batch["item_id"].take(pa.array(x.text)), "surface": shown.take(pa.array(x.surface)), "ordinal": pa.array(x.ordinal, pa.int32()),
                    "start": pa.array(x.start, pa.int32(), mask=none), "end": pa.array(x.end, pa.int32(), mask=none), "normal_start": pa.array(x.normal_start, pa.int32()),
                    "normal_end": pa.array(x.normal_end, pa.int32()), "matched_text": _slices(texts, x.text, x.start, x.end), "bounded": pa.array(x.bounded),
                }
                found = pa.RecordBatch.from_pydict(columns)
                for at in range(0, found.num_rows, BATCH_ROWS):
                    yield found.slice(at, BATCH_ROWS)

    return run


def blocks_of(surfaces: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """The distinct surfaces in blocks of about `block_chars` characters, one after the other."""
    usable = surfaces.select("surface").filter(F.length("surface").between(1, MAX_SURFACE)).distinct()
    n = -(-(usable.agg(F.sum(F.length("surface"))).first()[0] or 0) // block_chars)
    for k in range(n):
        yield [r.surface for r in usable.filter(F.pmod(F.xxhash64("surface"), F.lit(n)) == k).collect()]


def locate(texts: DataFrame, surfaces: DataFrame, block_chars: int = BLOCK_CHARS, exact: bool = True) -> DataFrame:
    """(item_id, FIELDS): all non-overlapping places of each surface in each text, see `Automaton.places`.

    texts: item_id, text. surfaces: surface, in normal form; blank ones and those of more than MAX_SURFACE
    characters are left out. One pass over the texts for each block of surfaces; no text or empty text: no rows.
    """
    return _located(texts, list(blocks_of(surfaces, block_chars)), exact, False)


def _located(texts: DataFrame, blocks: list[list[str]], exact: bool, standing: bool) -> DataFrame:
    rows = texts.select("item_id", "text")
    schema = f"item_id {rows.schema['item_id'].dataType.simpleString()}, {FIELDS}"
    made = [rows.mapInArrow(_walk(block, exact, standing), schema) for block in blocks]
    out = made[0] if made else texts.sparkSession.createDataFrame([], schema)
    for more in made[1:]:
        out = out.unionByName(more)
    return out


def accepted(found: DataFrame) -> DataFrame:
    """Places between word bounds that have a piece of the original; their ordinals stay, so that they may have gaps."""
    return found.filter("bounded AND matched_text IS NOT NULL").drop("bounded")


def uncovered(hits: DataFrame) -> DataFrame:
    """Hits that are not strictly within a hit of another surface; one that covers the same piece of the original does not count.

    Pieces grow with places in the normal form, so two running maxima tell whether a longer hit is around.
    """
    by_place = Window.partitionBy("item_id").orderBy("normal_start").rangeBetween(Window.unboundedPreceding, 0)
    by_start = Window.partitionBy("item_id").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    marked = hits.withColumn("__beyond", F.max("end").over(by_place)).withColumn("__around", F.max("normal_end").over(by_start))
    inside = (F.col("__beyond") > F.col("end")) | F.coalesce(F.col("__around") >= F.col("normal_end"), F.lit(False))
    return marked.filter(~inside).drop("__beyond", "__around")


def surface_index(entities: DataFrame, aliases: DataFrame, retired: DataFrame) -> DataFrame:
    """(surface, entities, ambiguous): for each normal form the entities it may stand for, by id, each with its reasons.

    entities: entity_id, canonical, display. aliases: alias_id, entity_id, alias, kind. retired: entity_id.
    A reason is (method, matched_value, alias_kind), once each: canonical name, display name, aliases by id.
    """
    def names(df: DataFrame, method: str, value: str, kind: Column, order: Column) -> DataFrame:
        reason = F.struct(F.lit(method).alias("method"), F.col(value).alias("matched_value"), kind.alias("alias_kind"))
        return df.select("entity_id", F.col(value).alias("raw"), order.cast("long").alias("place"), reason.alias("reason"))

    none = F.lit("")
    rows = names(entities, "CANONICAL_NAME", "canonical", none, F.lit(-2)).unionByName(names(entities, "DISPLAY_NAME", "display", none, F.lit(-1)))
    rows = rows.unionByName(names(aliases, "ALIAS", "alias", F.coalesce("kind", none), F.col("alias_id")))
    rows = rows.join(retired.select("entity_id").distinct(), "entity_id", "left_anti").filter("raw IS NOT NULL")
    forms = rows.select("raw").distinct().withColumn("surface", normal_form("raw"))
    rows = rows.join(forms, "raw").filter(F.length("surface").between(1, MAX_SURFACE))
    once = rows.groupBy("surface", "entity_id", "reason").agg(F.min("place").alias("place"))
    per = once.groupBy("surface", "entity_id").agg(F.array_sort(F.collect_list(F.struct("place", "reason"))).alias("x"))
    per = per.groupBy("surface").agg(F.array_sort(F.collect_list(F.struct("entity_id", F.transform("x", lambda r: r["reason"]).alias("reasons")))).alias("entities"))
    return per.withColumn("ambiguous", F.size("entities") > 1)


def candidates(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Hits with every entity of their surface: entity_id, reasons and whether others share the surface.

    An index of up to BROADCAST_SURFACES entities, counted first, is broadcast, so that no hit is shuffled and a frequent surface is no hot key.
    """
    n = index.agg(F.sum(F.size("entities"))).first()[0] or 0
    known = index.select(F.col("surface").alias("__surface"), F.explode("entities").alias("__x"), "ambiguous")
    joined = hits.join(F.broadcast(known) if n <= BROADCAST_SURFACES else known, F.col("surface") == F.col("__surface"))
    return joined.select(*hits.columns, "ambiguous", F.col("__x.entity_id").alias("entity_id"), F.col("__x.reasons").alias("reasons"))


def detected(texts: DataFrame, index: DataFrame, exact: bool = True, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Candidates of the surviving hits of an index's surfaces in texts (item_id, text); for `exact` see `Automaton.places`.

    Hits that a longer one of the same text and block covers go in the walk itself. What is left is
    compared anew only where an item has several texts, or the index several blocks.
    """
    blocks = list(blocks_of(index, block_chars))
    hits = accepted(_located(texts, blocks, exact, True))
    if len(blocks) > 1 or not texts.groupBy("item_id").count().filter("count > 1").isEmpty():
        hits = uncovered(hits)
    return candidates(hits, index)
