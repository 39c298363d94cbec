"""A sink of text files that commits: tasks write hidden parts, the driver puts them in place once all tasks are done.

Rows are fragments of files: ``root`` (an existing folder, else the row is left out), ``path`` (the file, below it), ``kind`` and
``text``, ordered by file within and across tasks. ``open``, ``item`` and ``close`` are parts of JSON, between which the sink sets commas;
``line`` ends with a line end. A file that one task wrote is moved into place, which replaces an old one at once; one that several tasks wrote,
or that is appended to, is first put together from their parts, a block at a time. So readers meet the old file or the new one,
whole, and a write that fails or is stopped before its commit leaves every old file as it is.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from strata.sources.files import opened

_BLOCK = 4 << 20


@dataclass
class Part:
    """What one task wrote of one file: its place among the parts, and the kinds of its first and last fragment."""

    path: str
    place: int
    hidden: str
    first: str
    last: str


@dataclass
class Parts(WriterCommitMessage):
    parts: list[Part]
    again: bool


def between(before: str, kind: str) -> bytes:
    """What stands between two fragments."""
    if kind == "line" or not before:
        return b""
    return b",\n" if before in ("item", "close") and kind != "close" else b"\n"


class FragmentWriter(DataSourceArrowWriter):
    """Options: ``header``, the first line of new files; ``append``, whether to add to what a file holds."""

    def __init__(self, options: dict[str, str]):
        self.job = uuid.uuid4().hex[:12]
        self.header = options.get("header", "").encode()
        self.append = options.get("append", "false").lower() == "true"

    def _hidden(self, path: str, tail: str) -> str:
        folder, _, name = path.rpartition("/")
        return f"{folder}/.{name}.{self.job}-{tail}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        context = TaskContext.get()
        task, attempt = context.partitionId(), context.attemptNumber()
        made: list[Part] = []
        out, there = None, {}
        try:
            for batch in iterator:
                for root, path, kind, text in zip(*(batch.column(c).to_pylist() for c in ("root", "path", "kind", "text")), strict=True):
                    if root not in there:
                        fs, inner = opened(root)
                        there = {root: fs.get_file_info(inner).type == pafs.FileType.Directory}
                    if not there[root]:
                        continue
                    if not made or made[-1].path != path:
                        if out is not None:
                            out.close()
                        fs, inner = opened(path)
                        fs.create_dir(inner.rpartition("/")[0], recursive=True)
                        made.append(Part(path, task, self._hidden(path, f"{task}-{attempt}-{len(made)}"), kind, ""))
                        out = fs.open_output_stream(self._hidden(inner, f"{task}-{attempt}-{len(made) - 1}"))
                    out.write(between(made[-1].last, kind) + text.encode())
                    made[-1].last = kind
        except BaseException:
            self._remove(made)
            raise
        finally:
            if out is not None:
                out.close()
        return Parts(made, attempt > 0)

    def _remove(self, parts: list[Part]) -> None:
        for p in parts:
            fs, inner = opened(p.hidden)
            if fs.get_file_info(inner).type == pafs.FileType.File:
                fs.delete_file(inner)

    def commit(self, messages: list[Parts | None]) -> None:
        files: dict[str, list[Part]] = defaultdict(list)
        for m in messages:
            for p in m.parts if m else []:
                files[p.path].append(p)
        ready = []  # first all files are whole, then they are put in place
        for path, parts in files.items():
            parts.sort(key=lambda p: p.place)
            fs, inner = opened(path)
            old = self.append and fs.get_file_info(inner).type == pafs.FileType.File
            if len(parts) == 1 and not old and not self.header:
                ready.append((fs, opened(parts[0].hidden)[1], inner))
                continue
            joined = self._hidden(inner, "joined")
            with fs.open_output_stream(joined) as out:
                if old:
                    self._copy(fs, inner, out)
                else:
                    out.write(self.header)
                before = ""
                for p in parts:
                    out.write(between(before, p.first))
                    self._copy(fs, opened(p.hidden)[1], out)
                    before = p.last
            self._remove(parts)
            ready.append((fs, joined, inner))
        for fs, source, target in ready:
            fs.move(source, target)
        if any(m and m.again for m in messages):
            self._sweep(files)

    @staticmethod
    def _copy(fs: pafs.FileSystem, source: str, out: pa.NativeFile) -> None:
        with fs.open_input_stream(source) as f:
            while block := f.read(_BLOCK):
                out.write(block)

    def _sweep(self, paths) -> None:
        """What attempts that were lost left behind."""
        for folder in {p.rpartition("/")[0] for p in paths}:
            fs, inner = opened(folder)
            for e in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
                if e.base_name.startswith(".") and f".{self.job}-" in e.base_name:
                    fs.delete_file(e.path)

    def abort(self, messages: list[Parts | None]) -> None:
        done = [p for m in messages if m for p in m.parts]
        self._remove(done)
        self._sweep({p.path for p in done})


class FragmentSink(DataSource):
    """``df.write.format("fragments").mode("append").save()``; df: root, path, kind, text."""

    @classmethod
    def name(cls) -> str:
        return "fragments"

    def writer(self, schema, overwrite: bool) -> FragmentWriter:  # noqa: ARG002
        return FragmentWriter(dict(self.options))


def write_fragments(rows: DataFrame, order: list[str | Column], header: str = "", append: bool = False, parts: int | None = None) -> None:
    """Write fragments (root, path, kind, text and what ``order`` names) as files. Rows are dealt by ranges of path and order, so that
    neither a file nor a task has to hold what its neighbours hold."""
    spark = rows.sparkSession
    spark.dataSource.register(FragmentSink)
    keys = ["path", *order]
    dealt = rows.repartitionByRange(parts, *keys) if parts else rows.repartitionByRange(*keys)
    x = dealt.sortWithinPartitions(*keys).select("root", "path", "kind", "text")
    x.write.format("fragments").option("header", header).option("append", str(append)).mode("append").save()


def write_texts(rows: DataFrame, root: str, text: str, name: str) -> None:
    """One whole text for each root, in the file ``name`` below it."""
    x = rows.select(F.col(root).alias("root"), F.concat(F.col(root), F.lit("/" + name)).alias("path"), F.lit("line").alias("kind"), F.col(text).alias("text"))
    write_fragments(x.where("text IS NOT NULL"), [])
