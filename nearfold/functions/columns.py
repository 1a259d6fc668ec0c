"""Identifiers, lenient coercion and column lookup."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: accepted number spelling and boolean words -----------------
NUMBER_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_TEXT = r"^[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?$"
TRUE_WORDS = ("true", "1", "yes", "y", "t")
FALSE_WORDS = ("false", "0", "no", "n", "f")
# -------------------------------------------------------------------------------

#: Above this a double no longer holds every integer.
EXACT_INTEGER_LIMIT = 9e15


def first_present(df: DataFrame, candidates: Sequence[str]) -> str:
    """The first of ``candidates`` that ``df`` has; raises when it has none."""
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of the columns {list(candidates)} found in {df.columns}")


def require_columns(df: DataFrame, required: Sequence[str], source: str) -> DataFrame:
    missing = [name for name in required if name not in df.columns]
    if missing:
        raise ValueError(f"{source} is missing columns: {', '.join(missing)}")
    return df


def stripped(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")


def canonical_id(c: Column) -> Column:
    """Whole numbers become their digits (``12.0`` -> ``12``), other text is trimmed.

    Missing or blank input gives NULL. Numbers too large for a double to hold
    exactly keep their own spelling.
    """
    text = stripped(c)
    number = F.when(text.rlike(NUMBER_TEXT), text.try_cast("double"))
    whole = (number == F.floor(number)) & (F.abs(number) < EXACT_INTEGER_LIMIT)
    return F.when(text == "", F.lit(None)).when(whole, number.cast("bigint").cast("string")).otherwise(text)


def numeric_id(c: Column) -> Column:
    return c.try_cast("bigint")


def by_numeric_id(name: str) -> list[Column]:
    """Sort order: numeric ids first by value, then text ids."""
    return [numeric_id(F.col(name)).asc_nulls_last(), F.col(name).asc()]


def to_number(c: Column) -> Column:
    """Number or NULL: unreadable text and NaN both count as missing."""
    text = stripped(c)
    value = F.when(text.rlike(NUMBER_TEXT) | text.rlike(INFINITY_TEXT), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def to_flag(c: Column) -> Column:
    word = F.lower(stripped(c))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def positive(c: Column) -> Column:
    """A count of zero or less means the measurement failed: treat it as missing."""
    return F.when(c > 0, c)


def last_path_part(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]*)/*$", 1)


def path_stem(c: Column) -> Column:
    """Last path part without its final suffix; a leading dot is no suffix."""
    return F.regexp_replace(last_path_part(c), r"^(.+)\.[^.]+$", "$1")


def id_from_path(path: Column, pattern: str | None = None) -> Column:
    """Id of the file at ``path``: its folder's name, or what ``pattern`` finds.

    A pattern with a group yields that group, otherwise the whole match.
    All-digit ids lose leading zeros; a path the pattern misses fails the job.
    """
    if pattern is None:
        folder = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
        return F.when(folder != "", folder).otherwise(last_path_part(path))
    group = 1 if re.compile(pattern).groups else 0
    found = F.when(path.rlike(pattern), F.regexp_extract(path, pattern, group)).otherwise(
        F.raise_error(F.concat(F.lit("id pattern did not match: "), path)).cast("string")
    )
    return F.when(found.rlike(r"^[0-9]+$"), F.regexp_replace(found, r"^0+(?=[0-9])", "")).otherwise(found)


def natural_key(path: Column) -> Column:
    """Sort key under which digits compare as numbers and letters ignore case."""
    parts = F.regexp_extract_all(path, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    return F.transform(
        parts,
        lambda p: F.struct(
            F.when(p.rlike(r"^[0-9]+$"), p.try_cast("decimal(38,0)")).alias("number"),
            F.lower(p).alias("text"),
        ),
    )


def natural_order(path: str) -> list[Column]:
    return [natural_key(F.col(path)).asc(), F.col(path).asc()]


def strip_name(c: Column, prefix: str = "") -> Column:
    """File stem with an optional leading ``prefix`` removed."""
    stem = path_stem(c)
    if not prefix:
        return stem
    return F.when(stem.startswith(prefix), F.substring(stem, len(prefix) + 1, 1 << 30)).otherwise(stem)


def after_marker(c: Column, marker: str) -> Column:
    """Text after the first ``marker``, or all of it when the marker is absent."""
    if not marker:
        return c
    at = F.instr(c, marker)
    return F.when(at > 0, F.substring(c, at + F.lit(len(marker)), F.lit(1 << 30))).otherwise(c)
