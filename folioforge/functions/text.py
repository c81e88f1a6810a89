"""String rules as column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Long dashes and hyphens that searches and orders fold to "-"; the Hebrew maqaf is not one of them.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe58\ufe63\uff0d"
# Hebrew final letters and their ordinary forms.
FINALS, ORDINARY = "ךםןףץ", "כמנפצ"
SPACE = "[\\s\\x{00A0}]+"
#: What blanks are, as part of a class of characters.
_BLANKS = "\\s\\x{1C}-\\x{1F}\\x{85}\\p{Z}"
# Fixed value: the slug of a name that has none.
FALLBACK = "item"
TOKEN_GAP = "[^\\p{L}\\p{N}]+"


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once, although lambdas within use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fold_dashes(text: Column) -> Column:
    return F.translate(text, DASHES, "-" * len(DASHES))


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), TOKEN_GAP), lambda x: x != "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def ordered_names(raw: Column, gap: str = ",") -> Column:
    """Parts between separators, trimmed, blanks dropped, first occurrences kept."""
    return F.array_distinct(F.filter(F.transform(F.split(raw, gap), lambda x: F.trim(x)), lambda x: x != ""))


@F.pandas_udf(StringType())
def compatible(names: pd.Series) -> pd.Series:
    """NFKC, for which Spark has no function; null stays."""
    return names.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(StringType())
def folded(names: pd.Series) -> pd.Series:
    """NFC and full case folding, for which Spark has no function; null stays."""
    return names.map(lambda x: unicodedata.normalize("NFC", x).casefold(), na_action="ignore")


def slug(name: Column, size: int = 255) -> Column:
    """A name as part of an address: letters, digits and underscores of any script in lower case, blanks and hyphens as one hyphen, all else dropped; FALLBACK where nothing is left.

    Names that may hold compatibility forms are passed through `compatible` first, as `unique_slugs` does.
    """
    kept = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), f"[^\\p{{L}}\\p{{N}}_{_BLANKS}-]", "")
    base = F.regexp_replace(F.regexp_replace(kept, f"[{_BLANKS}-]+", "-"), "^[-_]+|[-_]+$", "")
    return F.when(base == "", FALLBACK).otherwise(F.substring(base, 1, size))


def index_letter(name: Column) -> Column:
    """First letter of a name: Hebrew finals folded, others upper-cased; "#" where a digit or nothing comes first."""
    first = F.regexp_extract(F.translate(F.coalesce(name, F.lit("")), FINALS, ORDINARY), "([\\p{L}\\p{N}])", 1)
    return F.when(first.rlike("^\\p{L}$"), F.upper(first)).otherwise("#")


def normal_whitespace(text: Column) -> Column:
    """Line ends to LF, hard spaces to spaces, each line's blanks collapsed and trimmed; blank lines are kept."""
    lf = F.regexp_replace(F.regexp_replace(text, "\\r\\n?", "\n"), "\\x{00A0}", " ")
    return F.array_join(F.transform(F.split(lf, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t]+", " "))), "\n")


def script_letters(text: Column, script: str) -> Column:
    """Letters of one script, URLs and mail addresses left out."""
    plain = F.regexp_replace(text, "https?://\\S+|\\S+@\\S+", " ")
    return F.length(F.regexp_replace(plain, f"[^\\p{{{script}}}]", "")).cast("long")


def reasons(raw: Column) -> Column:
    """A JSON array of strings, or the raw text as its only member; null and blank give none."""
    parsed = F.from_json(raw, "array<string>")
    return F.when(raw.isNull() | (F.trim(raw) == ""), F.array().cast("array<string>")).when(parsed.isNotNull(), parsed).otherwise(F.array(raw))


def clock_seconds(raw: Column) -> Column:
    """h:m:s, m:s or s as seconds; null for anything else."""
    parts = F.transform(F.split(F.trim(raw), ":"), lambda x: F.expr("bigint(0)") + F.when(x.rlike("^\\d{1,6}$"), x).cast("long"))
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 60 + x)
    return F.when(F.trim(raw).rlike("^\\d{1,6}(:[0-5]?\\d){0,2}$"), total)


def sort_key(name: Column) -> Column:
    """(script rank, key): Hebrew before Latin before others before empty; leading punctuation and case do not count.

    Case is lowered; names that need NFC or full folding are passed through `folded` first.
    """
    plain = F.trim(F.regexp_replace(F.lower(fold_dashes(F.coalesce(name, F.lit("")))), f"[{_BLANKS}]+", " "))
    key = F.translate(F.regexp_replace(plain, "^[\\p{M}\\p{P}\\p{S}\\p{C} ]+", ""), FINALS, ORDINARY)
    latin = key.rlike("^[a-z\\x{C0}-\\x{24F}\\x{1E00}-\\x{1EFF}]")
    rank = F.when(key == "", 3).when(key.rlike("^[\\x{0590}-\\x{05FF}]"), 0).when(latin, 1).otherwise(2)
    return F.struct(rank.alias("script"), key.alias("key"))


def json_hash(*fields: Column) -> Column:
    """SHA-256 of the fields' canonical JSON."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def stripped(text: Column) -> Column:
    """Without blanks of any kind at both ends."""
    return F.regexp_replace(text, "^[\\s\\x{00A0}]+|[\\s\\x{00A0}]+$", "")


def equivalent(a: Column, b: Column) -> Column:
    """Whether two texts are the same but for blanks at their ends; null is the empty text."""
    return stripped(F.coalesce(a, F.lit(""))) == stripped(F.coalesce(b, F.lit("")))


def joined_bands(texts: Column) -> Column:
    """Texts of a page's bands, stripped, one after the other in lines."""
    return F.array_join(F.transform(texts, stripped), "\n")


def suggested_values(raw: Column) -> Column:
    """Parts between commas and line ends, trimmed, blanks dropped, first occurrences kept."""
    return ordered_names(raw, "[\n,]")


def limited_names(raw: Column, longest: int) -> Column:
    """(names, error): comma-separated names, and whether one is too long."""
    return bound(ordered_names(F.coalesce(raw, F.lit(""))), lambda x: F.struct(x.alias("names"), F.exists(x, lambda n: F.length(n) > longest).alias("error")))
