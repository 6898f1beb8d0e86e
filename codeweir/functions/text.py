"""Analysis of search text as columns: tokens, word forms, overlap, feature hashing."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility normal form; Spark SQL has no such function. ASCII passes through untouched."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))


def split_camel(c: Column) -> Column:
    c = F.regexp_replace(c, r"([\p{Ll}\d])(\p{Lu})", "$1 $2")
    return F.regexp_replace(c, r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def word_forms(w: Column) -> Column:
    """The word, without a plural s (from five letters), and then without -ment (from seven)."""
    singular = (F.length(w) > 4) & w.endswith("s")
    base = F.when(singular, F.left(w, F.length(w) - 1)).otherwise(w)
    stem = F.when((F.length(base) > 6) & base.endswith("ment"), F.left(base, F.length(base) - 4)).otherwise(base)
    return F.array(w, base, stem)


def search_tokens(c: Column, normalise: bool = True) -> Column:
    """Distinct tokens in order of first appearance; empty for null text."""
    c = F.coalesce(c, F.lit(""))
    if normalise:  # only texts with other characters go to Python
        c = F.coalesce(nfkc(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)
    found = F.array_distinct(words(split_camel(c)))  # a repeated word adds no form; the order stays
    return F.array_distinct(F.flatten(F.transform(found, word_forms)))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the geometric mean of both sizes; 0 if either is empty."""
    size = F.size(a) * F.size(b)
    return F.when(size > 0, F.size(F.array_intersect(a, b)) / F.sqrt(size.cast("double"))).otherwise(F.lit(0.0))


def features(c: Column) -> Column:
    """w:word, and g:trigram for each trigram of words of three letters or more; repeats stay."""
    grams = lambda w: F.transform(
        F.when(F.length(w) >= 3, F.sequence(F.lit(1), F.length(w) - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(F.lit("g:"), F.substring(w, i, F.lit(3))),
    )
    return F.flatten(F.transform(words(c), lambda w: F.concat(F.array(F.concat(F.lit("w:"), w)), grams(w))))


def fnv1a(c: Column) -> Column:
    """32-bit FNV-1a over the UTF-16 units, unsigned, as a long; a character beyond the basic plane is two units."""
    points = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.ascii(F.substring(c, i, F.lit(1))).cast("long"))
    pair = lambda x: F.array(F.lit(0xD7C0) + F.shiftright(x, 10), F.lit(0xDC00) + x.bitwiseAND(0x3FF))
    units = F.flatten(F.transform(points, lambda x: F.when(x < 0x10000, F.array(x)).otherwise(pair(x))))
    return F.aggregate(units, F.lit(2166136261).cast("long"), lambda h, x: (h.bitwiseXOR(x) * 16777619).bitwiseAND(4294967295))


def middle_cut(c: Column, most: int, mark: str = "\n...\n") -> Column:
    """Long text cut in the middle: 70 % of the room from its start, 30 % from its end."""
    room = max(most - len(mark), 2)
    head = room * 7 // 10
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.left(c, F.lit(head)), F.lit(mark), F.right(c, F.lit(room - head))))
