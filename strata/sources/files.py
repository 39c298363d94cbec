"""Files on any file system that Arrow opens, as DataFrames: listing, packing by bytes, reading.

Paths are local ones or URIs (``file://``, ``s3://``, ``gs://``, ``hdfs://``). Everything that touches a file system runs in
tasks; the driver gets counts. Unlike Spark's own file sources these keep hidden names and empty files.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.storage import discard, written

#: Folders that a task opens below one that it is given, before it hands those that are left to other tasks.
OPEN_FOLDERS = 500
#: What a file weighs besides its bytes: opening it costs about as much as reading so many.
OPEN_BYTES = 1024
#: A partition's weight: at most the first (more only where one file is larger), at least the second.
MOST_BYTES, LEAST_BYTES = 64 << 20, 256 << 10
#: Files up to this size may set the weight of all partitions, so that partitions are about alike; larger ones have one of their own.
EVEN_BYTES = 256 << 20
#: Files beyond this are no rows: listed, but not read.
ROW_BYTES = 1 << 30
#: The class of small files: up to a weight of a part's over two to this power.
SMALL = 4
_BATCH_ROWS, _BATCH_BYTES = 10_000, 8 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def below(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}" if name else folder


def entries(fs: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    """What lies in a folder; nothing if it cannot be opened."""
    try:
        return fs.get_file_info(pafs.FileSelector(folder))
    except OSError:
        return []


def walked(fs: pafs.FileSystem, base: str, start: str, suffix: str, pruned: tuple[str, ...], most: int) -> Iterator[tuple[str, int, bool]]:
    """(relative path, size, False) of files below a folder, and (relative path, 0, True) of folders that were left after ``most`` were opened.

    Links to folders are not followed.
    """
    todo, n = deque([start]), 0
    while todo and n < most:
        folder = todo.popleft()
        n += 1
        for e in entries(fs, below(base, folder)):
            if e.base_name in pruned:
                continue
            rel = f"{folder}/{e.base_name}" if folder else e.base_name
            if e.type == pafs.FileType.Directory:
                if not (isinstance(fs, pafs.LocalFileSystem) and os.path.islink(e.path)):
                    todo.append(rel)
            elif e.type == pafs.FileType.File and e.base_name.endswith(suffix):
                yield rel, e.size or 0, False
    for folder in todo:
        yield folder, 0, True


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH_ROWS:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in held], schema)


def listed(roots: DataFrame, suffix: str, pruned: tuple[str, ...] = (), open_folders: int | None = None) -> DataFrame:
    """(repo, rel_path, size) of all files below the roots (repo) with the suffix, written.

    Round by round: a task opens some folders below each that it has; the rest is dealt to the tasks of the next round. So one deep
    tree becomes many tasks after a few rounds, and a small one needs a single round.
    """
    spark = roots.sparkSession
    most = open_folders or OPEN_FOLDERS
    schema = pa.schema([("repo", pa.string()), ("rel_path", pa.string()), ("size", pa.int64()), ("is_dir", pa.bool_())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for repo, folder in zip(batch.column("repo").to_pylist(), batch.column("rel_path").to_pylist(), strict=True):
                    fs, base = opened(repo)
                    for found in walked(fs, base, folder, suffix, pruned, most):
                        yield repo, *found

        yield from _batches(rows(), schema)

    level = roots.select("repo", F.lit("").alias("rel_path"))
    rounds: list[DataFrame] = []
    n = level.count()
    while n:
        level = level.repartition(min(n, 8 * spark.sparkContext.defaultParallelism))
        rounds.append(written(level.mapInArrow(walk, "repo string, rel_path string, size long, is_dir boolean"), "listed"))
        level = rounds[-1].where("is_dir").select("repo", "rel_path")
        n = level.count()
    files = spark.createDataFrame([], "repo string, rel_path string, size long")
    for part in rounds:
        files = files.unionByName(part.where("NOT is_dir").drop("is_dir"))
    out = written(files, "files", {"maxRecordsPerFile": "1000000"})
    discard(*rounds)
    return out


def partition_weight(total: int, largest: int, parallelism: int) -> int:
    """The weight of a partition: enough partitions for all cores, none below a file that may set it."""
    return max(LEAST_BYTES, min(MOST_BYTES, total // (4 * parallelism)), largest if largest <= EVEN_BYTES else 0)


def packed(files: DataFrame, parallelism: int | None = None) -> tuple[DataFrame, int]:
    """Files (written, with size) with ``part``, and the number of parts, which are about alike in weight.

    A file larger than a part's weight has a part of its own. Those above a sixteenth of it fall in classes within a factor of two, and as many
    of one class as surely fit make a part, by their place in the listing; what is left of the classes is put together, first fit by
    size. The small ones fill these, then parts of equal shares, by the sum of what comes before them in the listing.
    The driver gets a count and a sum for each class and file of the listing.
    """
    from pyspark.sql import Window

    spark = files.sparkSession
    w = F.greatest(F.col("size"), F.lit(0)) + OPEN_BYTES
    total, largest = files.agg(F.coalesce(F.sum(w), F.lit(0)), F.coalesce(F.max(w), F.lit(0))).first()
    most = partition_weight(total, largest, parallelism or spark.sparkContext.defaultParallelism)
    size_class = sum(((w <= (most >> i)).cast("int") for i in range(SMALL + 1)), F.lit(-1))  # -1: larger than a part
    x = files.select("*", w.alias("w"), size_class.alias("class"), F.col("_metadata.file_path").alias("of"), F.col("_metadata.row_index").alias("at"))
    counts = sorted(map(tuple, x.groupBy("of", "class").agg(F.count("*").alias("n"), F.sum("w").alias("w")).collect()), key=lambda r: (r[1], r[0]))
    before, sums, small = [], dict.fromkeys(range(-1, SMALL), 0), 0
    for of, c, n, weight in counts:
        before.append((of, c, small if c == SMALL else sums[c]))
        if c == SMALL:
            small += weight
        else:
            sums[c] += n
    first, parts, rests = {}, 0, []  # each class's first part; the parts so far; what is left of each class
    for c, n in sums.items():
        first[c] = parts
        parts += n >> max(c, 0)
        if rest := n & ((1 << max(c, 0)) - 1):
            rests.append((rest * (most >> c), c))
    bins: list[int] = []
    put: dict[int, int] = {}
    for weight, c in sorted(rests, reverse=True):
        i = next((i for i, held in enumerate(bins) if held + weight <= most), len(bins))
        bins[i:] = [bins[i] + weight if i < len(bins) else weight, *bins[i + 1 :]]
        put[c] = parts + i
    shared = parts + len(bins)
    gaps = [most - held for held in bins]
    rest = small - sum(gaps)
    between = any(sums[c] for c in range(1, SMALL))  # parts that may be little over half full: none is to exceed the weight then
    alike = max(0, -(-rest // most) if between else max(int(rest > 0), round(rest / most)))  # parts of small files only
    if rest > 0 and 2 * rest < most and shared >= 4:  # too little for a part: spread over all
        gaps, alike, spread, n = [], shared, 0, shared
    else:
        gaps, spread, n = [g * min(1, small / sum(gaps)) for g in gaps] if sum(gaps) else [], shared, shared + alike
    share = max(1.0, (small - sum(gaps)) / alike) if alike else 1.0
    place = spark.createDataFrame([(of, c, b, first.get(c, 0), sums.get(c, 0) >> max(c, 0), put.get(c, 0)) for of, c, b in before], "of string, class int, before long, first int, full long, rest int")
    own = Window.partitionBy("of", "class").orderBy("at")
    x = x.join(F.broadcast(place), ["of", "class"])  # a row for each file of the listing and class
    x = x.withColumn("n", F.col("before") + F.row_number().over(own) - 1).withColumn("upto", F.col("before") + F.sum("w").over(own) - F.col("w"))
    left = F.col("upto") - sum(gaps)
    even = F.lit(spread) + F.least(F.greatest(F.floor(left / share), F.lit(0)), F.lit(max(0, alike - 1)))
    for i in reversed(range(len(gaps))):
        even = F.when(F.col("upto") < sum(gaps[: i + 1]), F.lit(parts + i)).otherwise(even if alike or i + 1 < len(gaps) else F.lit(parts + i))
    by_class = F.expr("shiftrightunsigned(n, greatest(class, 0))")
    part = F.when(F.col("class") == SMALL, even).when(by_class < F.col("full"), F.col("first") + by_class).otherwise(F.col("rest"))
    return x.select(*files.columns, part.cast("int").alias("part")), n


def read(files: DataFrame) -> DataFrame:
    """(repo, rel_path, content, readable) of every file (repo, rel_path, size). Content is null where a file cannot be read or exceeds ``ROW_BYTES``."""
    schema = pa.schema([("repo", pa.string()), ("rel_path", pa.string()), ("content", pa.binary()), ("readable", pa.bool_())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, known = [], 0, {}
        for batch in batches:
            for repo, rel, n in zip(*(batch.column(c).to_pylist() for c in ("repo", "rel_path", "size")), strict=True):
                if repo not in known:
                    known = {repo: opened(repo)}
                fs, base = known[repo]
                content = None
                if n is None or n <= ROW_BYTES:
                    try:
                        with fs.open_input_file(below(base, rel)) as f:
                            content = f.read()
                    except OSError:
                        pass
                held.append({"repo": repo, "rel_path": rel, "content": content, "readable": content is not None})
                size += len(content or b"") + 100
                if size >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return files.select("repo", "rel_path", "size").mapInArrow(load, "repo string, rel_path string, content binary, readable boolean")


def read_packed(files: DataFrame) -> DataFrame:
    """The same, with the files dealt to partitions of about equal bytes."""
    rows, n = packed(files)
    return read(rows.repartitionById(n, "part") if n else rows)


def folders(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, is_dir): whether each path is a folder, looked up in tasks."""
    schema = pa.schema([("path", pa.string()), ("is_dir", pa.bool_())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for path in batch.column("path").to_pylist():
                    try:
                        fs, inner = opened(path)
                        yield path, fs.get_file_info(inner).type == pafs.FileType.Directory
                    except (OSError, pa.ArrowInvalid):
                        yield path, False

        yield from _batches(rows(), schema)

    return paths_of(spark, paths).mapInArrow(look, "path string, is_dir boolean")


def paths_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path) dealt to as many tasks as there are cores, or paths."""
    x = spark.createDataFrame([(p,) for p in paths], "path string")
    return x.repartition(max(1, min(len(paths), 4 * spark.sparkContext.defaultParallelism)))


def texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content, readable) of single files."""
    x = paths_of(spark, paths).select(F.col("path").alias("repo"), F.lit("").alias("rel_path"), F.lit(None).cast("long").alias("size"))
    return read(x).select(F.col("repo").alias("path"), "content", "readable")
