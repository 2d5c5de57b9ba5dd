"""Trees of files on a shared mount, listed and written by tasks.

Reading: each partition of the data source lists a part of the tree, so that names never gather on the
driver and files without a byte are listed too. Writing: one file per row under its relative path. A task
writes into a folder of its own attempt; only the commit moves files to their places, and an attempt that
failed leaves nothing there.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage)

#: Folders that the driver opens to share a tree out; it sees no more of it.
OPENED = 256
#: A folder with more folders than this is dealt to this many tasks by the names in it.
WIDE = 1024
SHARES = 64
#: Names, and bytes of content, in one batch of a task.
BATCH_NAMES = 10_000
BATCH_BYTES = 16 << 20
#: Bytes of content a reading task is meant to have.
TASK_BYTES = 128 << 20
_STAGING = ".lexiloom-"


def local_root(spark: SparkSession, root: str) -> str | None:
    """The path of ``root`` if Spark finds it among files of a mount, else null."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    return full.getPath() if full.getScheme() == "file" else None


def _is_folder(entry: os.DirEntry) -> bool:
    return entry.is_dir(follow_symlinks=False) and not entry.name.startswith((_STAGING, "_temporary"))


@dataclass
class Part(InputPartition):
    """Files of one folder, with those below it if ``deep``, and of its names only a share."""

    folder: str
    deep: bool
    share: int = 0
    shares: int = 1


class TreeReader(DataSourceReader):
    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root, suffix

    def partitions(self) -> list[Part]:
        waiting, parts = deque([""]), []
        while waiting and len(parts) < OPENED:
            folder, below = waiting.popleft(), []
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for entry in entries:
                    if _is_folder(entry):
                        below.append(os.path.join(folder, entry.name))
                        if len(below) > WIDE:
                            break
            if len(below) > WIDE:
                parts += [Part(folder, True, i, SHARES) for i in range(SHARES)]
            else:
                parts.append(Part(folder, False))
                waiting.extend(sorted(below))
        return parts + [Part(folder, True) for folder in waiting]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int]] = []
        for row in self._files(part):
            rows.append(row)
            if len(rows) == BATCH_NAMES:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    def _files(self, part: Part) -> Iterator[tuple[str, int]]:
        waiting, shares = [part.folder], part.shares
        while waiting:
            folder = waiting.pop()
            with os.scandir(os.path.join(self.root, folder)) as entries:
                for entry in entries:
                    if shares > 1 and zlib.crc32(os.fsencode(entry.name)) % shares != part.share:
                        continue
                    name = os.path.join(folder, entry.name)
                    if part.deep and _is_folder(entry):
                        waiting.append(name)
                    elif entry.name.endswith(self.suffix) and entry.is_file():
                        yield name, entry.stat().st_size
            shares = 1  # only the names of the first folder are shared out

    def _batch(self, rows: list[tuple[str, int]]) -> pa.RecordBatch:
        names = pa.array([name for name, _ in rows], pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array([n for _, n in rows], pa.int64())],
                                          ["rel_path", "length"])


@dataclass
class Staged(WriterCommitMessage):
    folder: str


class TreeWriter(DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite = root, overwrite
        self.staging = os.path.join(root, _STAGING + uuid.uuid4().hex)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        folder = os.path.join(self.staging, uuid.uuid4().hex)
        made: set[str] = set()
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                self._put(folder, name, content or b"", made)
        return Staged(folder)

    def _put(self, folder: str, name: str | None, content: bytes, made: set[str]) -> None:
        if not name or name.startswith("/") or {"", ".", ".."} & set(name.split("/")):
            raise ValueError(f"not a path below the root: {name!r}")
        path = os.path.join(folder, name)
        parent = os.path.dirname(path)
        if parent not in made:
            os.makedirs(parent, exist_ok=True)
            made.add(parent)
        try:
            with open(path, "xb") as file:
                file.write(content)
        except FileExistsError:
            raise ValueError(f"two rows have the path {name!r}") from None

    def _moves(self, messages: list[Staged | None]) -> Iterator[tuple[str, str]]:
        for message in messages:
            for at, _, names in os.walk(message.folder) if message else ():
                target = os.path.normpath(os.path.join(self.root, os.path.relpath(at, message.folder)))
                for name in names:
                    yield os.path.join(at, name), os.path.join(target, name)

    def commit(self, messages: list[Staged | None]) -> None:
        try:
            for _, target in self._moves(messages):
                if os.path.isdir(target) or not self.overwrite and os.path.lexists(target):
                    raise FileExistsError(f"there already: {target}")
            for made, target in self._moves(messages):
                os.makedirs(os.path.dirname(target), exist_ok=True)
                os.replace(made, target)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lexiloom_tree"

    def schema(self) -> str:
        return "rel_path string, length bigint"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"], self.options.get("suffix", ""))

    def writer(self, schema, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options["path"], overwrite)


def list_tree(spark: SparkSession, root: str, suffix: str = "") -> DataFrame:
    """``rel_path, length`` of the files below ``root`` whose names end in ``suffix``, empty ones too.

    Names that begin with a dot or an underscore are listed as well; links to folders are not followed.
    A name that is no text in UTF-8 is an error. ``root`` is a path on a mount that all executors have.
    """
    spark.dataSource.register(TreeSource)
    return spark.read.format(TreeSource.name()).option("suffix", suffix).load(root)


def read_contents(files: DataFrame, root: str) -> DataFrame:
    """``rel_path, content`` of listed files, dealt to tasks by their names, a few megabytes at a time."""
    spark = files.sparkSession
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(50_000, total // TASK_BYTES))

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(data, pa.binary())],
                                              ["rel_path", "content"])

        names, data, size = [], [], 0
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with open(os.path.join(root, name), "rb") as file:
                    data.append(file.read())
                names.append(name)
                size += len(data[-1])
                if size >= BATCH_BYTES:
                    yield packed()
                    names, data, size = [], [], 0
        if names:
            yield packed()

    # Names are small: left to itself, Spark would put them all into one task.
    dealt = files.select("rel_path").repartition(tasks, "rel_path")
    return dealt.mapInArrow(contents, "rel_path string, content binary")


def write_tree(df: DataFrame, root: str, content: str = "text", overwrite: bool = False) -> None:
    """One file per row of ``rel_path`` and ``content`` (text as UTF-8, or bytes; null is an empty file).

    Two rows of one path, paths that lead out of the root, and files that are there already (unless
    ``overwrite``) are errors that leave the tree as it was; other files in it stay. Tasks write, the
    driver only moves what they name. ``root`` is a path on a mount that all executors have.
    """
    spark = df.sparkSession
    path = local_root(spark, root)
    if path is None:
        raise ValueError(f"not on a mount: {root}")
    spark.dataSource.register(TreeSource)
    rows = df.select("rel_path", F.col(content).cast("binary").alias("content")).repartition("rel_path")
    rows.write.format(TreeSource.name()).mode("overwrite" if overwrite else "append").save(path)


def write_one_file(lines: DataFrame, target: str, separator: str = "\n", begin: str = "", end: str | None = None) -> None:
    """The one text column of sorted rows as one file: tasks write parts and copy them to their places in it.

    Every row is followed by the separator; with ``end`` the last one is followed by that instead. The file
    appears whole or not at all. ``target`` is a path on a mount that all executors have; a file that is
    there already is an error.
    """
    spark = lines.sparkSession
    path = local_root(spark, target)
    if path is None:
        raise ValueError(f"not on a mount: {target}")
    if os.path.lexists(path):
        raise FileExistsError(f"there already: {path}")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    staging = os.path.join(os.path.dirname(path), _STAGING + uuid.uuid4().hex)
    try:
        lines.write.text(f"file:{staging}/parts", lineSep=separator)
        _join_parts(spark, f"{staging}/parts", f"{staging}/whole", begin.encode(), separator.encode(), end)
        os.replace(f"{staging}/whole", path)
    finally:
        shutil.rmtree(staging, ignore_errors=True)


def _join_parts(spark: SparkSession, folder: str, target: str, begin: bytes, separator: bytes, end: str | None) -> None:
    numbers = {name: re.match(r"part-(\d+)", name) for name in os.listdir(folder)}
    names = sorted((name for name, found in numbers.items() if found), key=lambda name: int(numbers[name][1]))
    sizes = [os.path.getsize(os.path.join(folder, name)) for name in names]
    whole = len(begin) + sum(sizes) - (len(separator) if end is not None and any(sizes) else 0)
    places, at = [], len(begin)
    for name, size in zip(names, sizes):
        if size:
            places.append((name, at, min(size, whole - at)))
        at += size
    with open(target, "wb") as file:
        file.write(begin)
        file.truncate(whole)
        file.seek(whole)
        file.write((end or "").encode())

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, at, size in zip(*(column.to_pylist() for column in batch.columns)):
                with open(os.path.join(folder, name), "rb") as source, open(target, "r+b") as file:
                    file.seek(at)
                    for start in range(0, size, BATCH_BYTES):
                        file.write(source.read(min(BATCH_BYTES, size - start)))
                    file.flush()
                    os.fsync(file.fileno())
            yield pa.RecordBatch.from_arrays([batch.column(2)], ["size"])

    if places:
        dealt = spark.createDataFrame(places, "name string, at bigint, size bigint").repartition(len(places))
        copied = dealt.mapInArrow(copy, "size bigint").agg(F.sum("size")).first()[0]
        if copied != whole - len(begin):
            raise OSError(f"copied {copied} of {whole - len(begin)} bytes")
