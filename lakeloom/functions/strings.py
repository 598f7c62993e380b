"""String, regular expression, encoding and distance functions with the dialect's semantics."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def concat(*parts: Column) -> Column:
    """Nulls are skipped."""
    return F.concat_ws("", *parts)


def left(s: Column, n: int) -> Column:
    """A negative n drops that many characters from the right."""
    return F.substr(s, F.lit(1), F.lit(n)) if n >= 0 else F.substr(s, F.lit(1), F.greatest(F.length(s) + n, F.lit(0)))


def right(s: Column, n: int) -> Column:
    """A negative n drops that many characters from the left."""
    return F.right(s, F.lit(n)) if n >= 0 else F.substr(s, F.lit(1 - n), F.length(s))


def substring(s: Column, start: int, size: int | None = None) -> Column:
    """Start 0 is the place before the first character, and takes up one of the size."""
    if start == 0:
        return F.substr(s, F.lit(1), F.lit(max(0, size - 1)) if size is not None else F.length(s))
    return F.substr(s, F.lit(start), F.lit(size) if size is not None else F.length(s))


def string_split(s: Column, separator: str) -> Column:
    return F.split(s, re.escape(separator) if separator else "")


def regexp_replace(s: Column, pattern: str, replacement: str, options: str = "") -> Column:
    """The first match only, or all with option g; groups are written \\1."""
    flags = "".join(x for x in options if x in "is")
    prefix = f"(?{flags})" if flags else ""
    spark = re.sub(r"\\(\d)", lambda m: f"${int(m[1]) + (0 if 'g' in options else 1)}", replacement)
    if "g" in options:
        return F.regexp_replace(s, prefix + pattern, spark)
    return F.regexp_replace(s, f"(?s)^(.*?)(?-s:{prefix}{_shifted(pattern)})", "$1" + spark)


def _shifted(pattern: str) -> str:
    """Back references inside a pattern that gets one more group in front."""
    return re.sub(r"\\([1-9])", lambda m: f"\\{int(m[1]) + 1}", pattern)


def regexp_full_match(s: Column, pattern: str) -> Column:
    return s.rlike(f"^(?:{pattern})$")


def similar_to(s: Column, pattern: str, escape: str = "\\") -> Column:
    """SQL regular expressions: % and _ are wildcards, the pattern covers the whole string."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == escape and k + 1 < len(pattern):
            k += 1
            out.append(re.escape(pattern[k]))
        elif c == "[" and "]" in pattern[k + 1 :]:
            end = pattern.index("]", k + 1)
            out.append(pattern[k : end + 1])
            k = end
        else:
            out.append({"%": ".*", "_": ".", ".": r"\.", "^": r"\^", "$": r"\$"}.get(c, c))
        k += 1
    return s.rlike("(?s)^(?:" + "".join(out) + ")$")


def list_position_of(s: Column, part: Column) -> Column:
    return F.instr(s, part)


def position(part: Column, s: Column) -> Column:
    """POSITION(part IN s): from 1, 0 if absent."""
    return F.call_function("locate", part, s).cast("long")


def like_escape(s: Column, pattern: Column, escape: str) -> Column:
    return F.like(s, pattern, F.lit(escape))


def sha256(s: Column) -> Column:
    return F.sha2(s, 256)


def sha512(s: Column) -> Column:
    return F.sha2(s, 512)


def encode(s: Column) -> Column:
    return F.encode(s, "UTF-8")


def decode(b: Column) -> Column:
    return F.decode(b, "UTF-8")


#: The dialect's names of Spark's types.
TYPE_NAMES = {"tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "binary": "BLOB", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE", "interval": "INTERVAL", "void": "\"NULL\""}


def typeof(x: Column) -> Column:
    """The dialect's name of a type; lists of such types and decimals too, other nested types as Spark spells them."""
    name = F.typeof(x)
    inner = F.regexp_replace(name, "^(array<)*|>*$", "")
    known = F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*(F.lit(v) for kv in TYPE_NAMES.items() for v in kv)), lambda k, _: k == inner)), F.lit(0)), F.upper(inner))
    return F.concat(known, F.repeat(F.lit("[]"), F.regexp_count(name, F.lit("array<"))))


def pg_typeof(x: Column) -> Column:
    return F.lower(typeof(x))


def url_encode(s: Column) -> Column:
    """Blanks as %20."""
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def hamming(a: Column, b: Column) -> Column:
    """Null where lengths differ."""
    differ = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x != y, 1).otherwise(0))
    return F.when(F.length(a) == F.length(b), F.aggregate(differ, F.lit(0), lambda t, x: t + x).cast("long"))


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of characters."""
    x, y = (F.array_distinct(F.filter(F.split(s, ""), lambda c: c != "")) for s in (a, b))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def _pairwise(f):
    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)])

    return over


def _osa(a: str, b: str) -> int:
    before, last, row = [], [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = last, row, [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
    return row[-1]


def _jaro(a: str, b: str) -> float:
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = [True] * len(b), []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, f in zip(b, free, strict=True) if not f]
    swapped = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swapped) / m) / 3


def _jaro_winkler(a: str, b: str) -> float:
    base = _jaro(a, b)
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return base + same * 0.1 * (1 - base) if base >= 0.7 else base


damerau_levenshtein = F.pandas_udf(_pairwise(_osa), T.LongType())
jaro_similarity = F.pandas_udf(_pairwise(_jaro), T.DoubleType())
jaro_winkler_similarity = F.pandas_udf(_pairwise(_jaro_winkler), T.DoubleType())


@F.pandas_udf(T.StringType())
def strip_accents(s: pd.Series) -> pd.Series:
    return s.map(lambda x: x if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))
