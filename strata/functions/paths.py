"""Scalar functions over relative paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def module_name(path: Column) -> Column:
    """Dotted module of a relative path: no suffix, no leading ``src``."""
    bare = F.split(F.regexp_replace(path, F.lit("(?<=[^/])[.][^./]+$"), F.lit("")), "/")
    rest = F.slice(bare, 2, F.greatest(F.size(bare) - 1, F.lit(0)))
    return F.array_join(F.when(F.get(bare, F.lit(0)) == "src", rest).otherwise(bare), ".")


def top_folder(path: Column) -> Column:
    """First folder of a relative path, the second part under ``src``, ``.`` at the root."""
    clean = F.trim(F.replace(path, F.lit("\\"), F.lit("/")), F.lit("/"))
    parts = F.split(clean, "/")
    return (
        F.when(clean == "", ".")
        .when(F.get(parts, F.lit(0)) == "src", F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(".")))
        .when(F.size(parts) >= 2, F.get(parts, F.lit(0)))
        .otherwise(".")
    )


def base_name(path: Column) -> Column:
    return F.coalesce(F.nullif(F.substring_index(path, "/", -1), F.lit("")), path)


def url_name(url: Column) -> Column:
    """Repository name of a clone URL."""
    return F.regexp_replace(F.substring_index(F.rtrim(url, F.lit("/")), "/", -1), F.lit("[.]git$"), F.lit(""))
