"""Expressions for file names, dates, percent values, tree numbers and column names."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def article_name(archive_path: Column) -> Column:
    """Name of an article package: the path from its 7th character up to the last ``.tar``."""
    return F.nullif(F.regexp_extract(archive_path, r"^.{6}(.*)\.tar", 1), F.lit(""))


def base_name(path: Column) -> Column:
    """Last part of a path without the extension ``.txt`` or ``.nxml``."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.(txt|nxml)$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def timestamp_day(text: Column) -> Column:
    """Day of ``yyyy-MM-dd HH:mm:ss``; null if it is not a date."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def header_date(text: Column, today: dt.date | None = None) -> Column:
    """Day of ``dd-MMM-yy``. The century puts the year within 80 years back and 20 years ahead of today."""
    pivot = ((today or dt.date.today()).year + 20) % 100
    century = ((today or dt.date.today()).year + 20) // 100
    two = F.regexp_extract(text, r"-(\d{2})$", 1).try_cast("int")
    year = F.when(two <= pivot, two + century * 100).otherwise(two + (century - 1) * 100)
    stem = F.initcap(F.lower(F.regexp_extract(text, r"^(\d{2}-[A-Za-z]{3})-\d{2}$", 1)))
    return F.try_to_date(F.concat(stem, F.lit("-"), year.cast("string")), "dd-MMM-yyyy")


def percent(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+)\s*%", 1).try_cast("int")


def tree_parent(mn: Column) -> Column:
    """Parent of a tree number: none for the root, the root for a letter, the letter for ``A01``, else one part less."""
    return (
        F.when(mn == "0", F.lit(""))
        .when(F.length(mn) == 1, F.lit("0"))
        .when(~F.contains(mn, F.lit(".")), F.substring(mn, 1, 1))
        .otherwise(F.regexp_replace(mn, r"\.[^.]*$", ""))
    )


def tree_path(mn: Column) -> Column:
    """The tree number with all its ancestors: dotted prefixes, then the letter, then the root ``0``."""
    parts = F.split(mn, r"\.")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))
    return F.array_distinct(F.concat(prefixes, F.array(F.substring(mn, 1, 1), F.lit("0"))))


def snake_case(name: str) -> str:
    """``pdbId`` -> ``pdb_id``; blanks and dots become underscores."""
    name = re.sub(r"[\s.]+", "_", name.strip())
    return re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(c) for c in df.columns])


def dot(a: Column, b: Column) -> Column:
    """Dot product of two numeric arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
