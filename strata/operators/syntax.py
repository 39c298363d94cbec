"""Facts of Python source files, from one parse each, in Arrow batches; and the imports resolved by joins."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.paths import module_name
from strata.functions.text import line_count, marker_count, source_text
from strata.operators import parse as parsing

FACTS = (
    "repo string, rel_path string, lines long, todo long, fixme long, function_count int, class_count int, parse_status string, "
    "imports array<struct<level:int,module:string,names:array<string>>>"
)


def file_facts(files: DataFrame, memory: int = parsing.MEMORY_BYTES, seconds: float = parsing.SECONDS) -> DataFrame:
    """Facts per file: lines, markers, functions, classes, raw imports; without any, and with the status ``unreadable``, of
    files that are listed but cannot be read. Each worker parses in a child of its own, which it keeps: a text that takes more memory or seconds than
    allowed costs that child and has no functions and imports. files: repo, rel_path, content, readable."""
    x = files.select("repo", "rel_path", F.when(F.col("readable"), source_text(F.col("content"))).alias("text"))
    x = x.select("repo", "rel_path", "text", line_count(F.col("text")).alias("lines"), marker_count(F.col("text"), "TODO").alias("todo"), marker_count(F.col("text"), "FIXME").alias("fixme"))

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("level", pa.int32()), ("module", pa.string()), ("names", pa.list_(pa.string()))]))
        parse = parsing.shared_parser(memory, seconds)
        for batch in batches:
            rows = [parse(t.as_py()) if t.is_valid else (None, None, "unreadable", []) for t in batch.column("text")]
            kept = [batch.column(c) for c in ("repo", "rel_path", "lines", "todo", "fixme")]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string(), kind))]
            yield pa.RecordBatch.from_arrays(
                [*kept, *columns], names=["repo", "rel_path", "lines", "todo", "fixme", "function_count", "class_count", "parse_status", "imports"]
            )

    return x.mapInArrow(facts, FACTS)


def import_refs(facts: DataFrame) -> DataFrame:
    """Distinct absolute module names that each file imports (repo, src, module).

    ``import a.b`` names a.b, ``from m import x`` names m. A relative import drops as many parts of the
    file's own module as it has dots, down to the root; without a module each imported name is one.
    """
    x = facts.select("repo", F.col("rel_path").alias("src"), F.split(module_name(F.col("rel_path")), "[.]").alias("own"), F.explode("imports").alias("i")).select("repo", "src", "own", "i.*")
    base = F.array_join(F.slice("own", 1, F.greatest(F.lit(0), F.size("own") - F.col("level"))), ".")
    under = lambda b, n: F.when(b == "", n).otherwise(F.concat_ws(".", b, n))
    single = F.col("module").isNotNull() & (F.col("module") != "")
    several = F.transform("names", lambda n: F.when(n == "*", base).otherwise(under(base, n)))
    modules = F.when(F.col("level") == 0, F.array("module")).when(single, F.array(under(base, F.col("module")))).otherwise(several)
    return x.select("repo", "src", F.explode(modules).alias("module")).where("module <> ''").distinct()


def module_map(files: DataFrame) -> DataFrame:
    """Module names of files; a package's file also owns the package's name. The greater path wins a name."""
    name = module_name(F.col("rel_path"))
    package = F.when(F.col("rel_path").endswith("/__init__.py"), F.regexp_replace(name, F.lit("(^|[.])__init__$"), F.lit("")))
    names = F.array_compact(F.array(name, package))
    return files.select("repo", "rel_path", F.explode(names).alias("module")).groupBy("repo", "module").agg(F.max("rel_path").alias("rel_path"))


def import_edges(facts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Edges between files of a repo (repo, src, dst), one for each imported module that is one of its files."""
    modules = module_map(facts if files is None else files)
    return import_refs(facts).join(modules, ["repo", "module"]).select("repo", "src", F.col("rel_path").alias("dst"))
