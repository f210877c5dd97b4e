"""Text functions: ids, tokens, shingles, guards, string similarity."""

from __future__ import annotations

import math
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

LETTER = r"[\p{L}\p{N}_]"


def fast_id(*parts: Column) -> Column:
    """An id from ASCII parts: joined, lower case, other characters to single underscores, none at the ends."""
    joined = F.concat_ws("_", *[F.coalesce(p, F.lit("")) for p in parts])
    return F.regexp_replace(F.regexp_replace(F.lower(joined), r"[^\p{L}\p{N}]+", "_"), "^_+|_+$", "")


@F.pandas_udf(StringType())
def normal_id(s: pd.Series) -> pd.Series:
    """The exact id: NFKC, runs of anything but letters, digits and _ to one _, none at the ends, case folded."""
    import re

    def one(x):
        x = re.sub(r"_+", "_", re.sub(r"\W+", "_", unicodedata.normalize("NFKC", x or ""))).strip("_")
        return x.casefold()

    return s.map(one)


@F.pandas_udf(StringType())
def strip_marks(s: pd.Series) -> pd.Series:
    """Without combining marks."""
    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def tokens(text: Column) -> Column:
    """Lower-case words of letters, digits and _."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({LETTER}+)"), 1)


def code_tokens(text: Column) -> Column:
    """Identifiers of two or more characters in lower case, and the parts of snake- and camel-case ones."""
    names = F.filter(F.regexp_extract_all(text, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), 1), lambda x: F.length(x) >= 2)
    parts = F.transform(names, lambda x: F.filter(F.regexp_extract_all(x, F.lit("([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"), 1), lambda p: (F.length(p) >= 2) & (p != x)))
    return F.concat(F.transform(names, F.lower), F.transform(F.flatten(parts), F.lower))


def shingles(text: Column, k: int = 3) -> Column:
    """Distinct runs of k characters; a shorter text is one run."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (k - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(k))))


def norm_label(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits to one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def numbers(text: Column) -> Column:
    """The sorted digit runs without leading zeros."""
    runs = F.regexp_extract_all(text, F.lit("([0-9]+)"), 1)
    return F.array_sort(F.transform(runs, lambda x: F.coalesce(F.nullif(F.regexp_replace(x, "^0+", ""), F.lit("")), F.lit("0"))))


def numbers_differ(a: Column, b: Column) -> Column:
    return (a != b) & (numbers(a) != numbers(b))


VARIANT = r"^(.*[a-z])([0-9]+[a-z]*|[a-z]{2,})$"


def variant_pair(a: Column, b: Column) -> Column:
    """Short labels with one stem and different endings."""
    stem_a, stem_b = F.regexp_extract(a, VARIANT, 1), F.regexp_extract(b, VARIANT, 1)
    return (F.greatest(F.length(a), F.length(b)) < 12) & (a != b) & (stem_a != "") & (stem_a == stem_b) & (F.regexp_extract(a, VARIANT, 2) != F.regexp_extract(b, VARIANT, 2))


def jaro_one(a: str, b: str) -> float:
    """Jaro similarity; two empty texts are equal."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken, found = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if b[j] == c and not taken[j]:
                taken[j] = True
                found.append(c)
                break
    if not found:
        return 0.0
    other = [c for c, t in zip(b, taken) if t]
    swaps = sum(x != y for x, y in zip(found, other)) // 2
    m = len(found)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_one(a: str, b: str) -> float:
    """Jaro, raised by a tenth of the rest for each of up to four equal first characters where it is over 0.7."""
    s = jaro_one(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return s + same * 0.1 * (1 - s) if s > 0.7 else s


@F.pandas_udf(DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([math.nan if x is None or y is None else jaro_one(x, y) for x, y in zip(a, b)])


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([math.nan if x is None or y is None else jaro_winkler_one(x, y) for x, y in zip(a, b)])


@F.pandas_udf(BooleanType())
def one_edit(a: pd.Series, b: pd.Series) -> pd.Series:
    """Texts of one length that differ by at most one substitution or one swap of neighbours."""

    def near(x, y):
        d = [k for k, (p, q) in enumerate(zip(x, y)) if p != q]
        return len(x) == len(y) and (len(d) < 2 or len(d) == 2 and d[1] == d[0] + 1 and x[d[0]] == y[d[1]] and x[d[1]] == y[d[0]])

    return pd.Series([near(x or "", y or "") for x, y in zip(a, b)])


def entropy(text: Column) -> Column:
    """Bits per character, 0 for an empty text."""
    n = F.length(text).cast("double")
    each = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    bits = F.aggregate(F.filter(each, lambda p: p > 0), F.lit(0.0), lambda s, p: s - p * F.log2(p))
    return F.when(n > 0, bits).otherwise(0.0)


def is_test_path(path: Column) -> Column:
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    parts = F.split(low, "/")
    name = F.element_at(parts, -1)
    return F.arrays_overlap(parts, F.array(*map(F.lit, ("test", "tests", "spec", "specs", "__tests__")))) | name.rlike(r"^(test_.*|.*_test|.*[._-](test|spec)|conftest)\.[a-z0-9]+$")
