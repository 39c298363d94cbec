"""Source trees, settings and stored documents below roots: local folders or URIs.

Names that begin with ``_`` or ``.`` and empty files count. Folders are pruned while walking; listing, reading and the check of roots
run in tasks (see :mod:`strata.sources.files`), which read partitions of about equal bytes.
"""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.text import source_text
from strata.sources import files

#: Path parts whose files are left out, fixed values.
PRUNED = (".git", "venv", ".venv", "env", ".env")
SCHEMA = "repo string, rel_path string, content binary, readable boolean"
CONFIG_NAME = ".architecture.json"


def absolute(roots: list[str]) -> list[str]:
    """Absolute paths of roots, each once; URIs stay as they are."""
    return list(dict.fromkeys(r.rstrip("/") if "://" in r else os.path.realpath(os.path.expanduser(r)) for r in roots))


def repos(spark: SparkSession, roots: list[str]) -> DataFrame:
    """One row per root: its absolute path, whether it is a folder, and why not."""
    x = files.folders(spark, absolute(roots))
    return x.select(F.col("path").alias("repo"), "path", F.col("is_dir").alias("valid"), F.when(~F.col("is_dir"), "Not a directory").alias("error"))


def local_corpus(base: str, names: list[str]) -> list[str]:
    """The named folders below ``base`` that exist, by name."""
    return [os.path.join(base, n) for n in sorted(names) if os.path.isdir(os.path.join(base, n))]


def url_name(url: str) -> str:
    """The folder that a clone of ``url`` has."""
    return url.rstrip("/").rpartition("/")[2].removesuffix(".git")


def read_urls(path: str) -> list[str]:
    """The lines of a list of clone URLs, without comments and empty ones."""
    with open(path, encoding="utf-8") as f:
        return [x for line in f if (x := line.partition("#")[0].strip())]


def read_trees(spark: SparkSession, roots: list[str] | DataFrame, suffix: str = ".py") -> DataFrame:
    """All source files of valid roots, as :data:`SCHEMA` has them. roots: paths, or the table of :func:`repos`."""
    good = (roots if isinstance(roots, DataFrame) else repos(spark, roots)).where("valid").select("repo")
    return files.read_packed(files.listed(good, suffix, PRUNED))


def read_config(spark: SparkSession, roots: list[str], name: str = CONFIG_NAME) -> DataFrame:
    """Settings per root: layer_order and scoring. A file that is missing, no JSON or no object gives none; an empty scoring too."""
    from strata.operators.metrics import settings

    known = spark.createDataFrame([(root, files.below(root, name)) for root in absolute(roots)], "repo string, path string")
    text = files.texts(spark, [files.below(root, name) for root in absolute(roots)]).where("readable").select("path", as_object("content").alias("text"))
    return known.join(text, "path").where("text IS NOT NULL").select("repo", settings(F.col("text")).alias("c")).select("repo", "c.*")


@F.udf(T.StringType(), useArrow=True)
def as_object(content: bytes) -> str | None:
    """The text of a JSON object, each key once (its last value counts), as strict JSON; null if the bytes are none."""
    try:
        found = json.loads(content.decode())
    except (ValueError, RecursionError):
        return None
    return json.dumps(found) if isinstance(found, dict) else None


def read_scans(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Stored scan documents, read in tasks: path, the document as text, and a message where there is none to use."""
    x = files.texts(spark, paths).select("path", F.when(F.col("readable"), source_text(F.col("content"))).alias("text"))
    missing = F.when(F.col("text").isNull(), F.concat(F.lit("Scan data not found at "), "path", F.lit(".")))
    v = F.try_parse_json("text")
    bad = F.when(F.col("text").isNotNull() & v.isNull(), F.concat(F.lit("Invalid scan data: "), "path", F.lit(".")))
    off = F.when(F.try_variant_get(v, "$.valid", "boolean") == F.lit(False), F.concat(F.lit("Invalid scan: "), F.coalesce(F.try_variant_get(v, "$.error", "string"), F.lit("Unknown error")), F.lit(".")))
    return x.select("path", "text", F.coalesce(missing, bad, off).alias("message"))
