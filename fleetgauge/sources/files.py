"""Whole files as rows, and rows as whole files: Python data sources over Arrow's file systems.

Spark's own file scan leaves out files without content and names that begin with ``_`` or ``.``,
and holds a file in one row.  Here folders are dealt to tasks, every task lists its own folders,
and content streams by in chunks, so a digest takes the same memory for a file of any size.
A store must be one that Arrow opens by URI (local, s3, gs, hdfs, abfs); others raise an error.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import translate
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

CHUNK = 1 << 20
# What a task of ``write_files`` has not finished; never listed.
DRAFT = re.compile(r"\..*\.[0-9a-f]{32}$")
BATCH_ROWS, BATCH_BYTES = 1000, 1 << 25
# A row of Spark holds less than two gigabytes; longer content is marked, not cut.
ROW_BYTES = 1 << 30
# Folders looked into on the driver until there are this many to deal out.
FOLDERS = 64

FACTS = "path string, name string, size_bytes long, modified timestamp, hidden boolean, read_error string"
COLUMNS = {"facts": FACTS, "sha256": f"{FACTS}, sha256 string", "content": f"{FACTS}, content binary"}


def open_store(uri: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path on it, and what stands before the path in a URI."""
    scheme, mark, rest = uri.partition(":")
    if not mark or "/" in scheme or scheme == "file":
        path = rest if scheme == "file" and mark else uri
        return fs.LocalFileSystem(), "/" + path.lstrip("/") if scheme == "file" and mark else path, "file:"
    store, path = fs.FileSystem.from_uri(quote(uri, safe=":/@*?[]{},"))
    return store, path, uri[:len(uri) - len(path)] if uri.endswith(path) else f"{scheme}://"


def _alternatives(pattern: str) -> list[str]:
    """``a{b,c}d`` written out."""
    found = re.search(r"\{([^{}]*)\}", pattern)
    if not found:
        return [pattern]
    return [x for part in found[1].split(",") for x in _alternatives(pattern[:found.start()] + part + pattern[found.end():])]


@dataclass
class Glob:
    """Folder that holds all matches, and one pattern for each further step of the path."""

    root: str
    steps: list[str]

    @classmethod
    def of(cls, path: str) -> Glob:
        parts = path.rstrip("/").split("/")
        first = next((n for n, p in enumerate(parts) if re.search(r"[*?\[{]", p)), len(parts))
        return cls("/".join(parts[:first]) or "/", ["|".join(translate(x) for x in _alternatives(p)) for p in parts[first:]])

    def fits(self, path: str, is_file: bool) -> bool:
        """A file must match every step (or lie below what does), a folder the steps so far."""
        rest = path[len(self.root):].strip("/")
        parts = rest.split("/") if rest else []
        if is_file and len(parts) < len(self.steps):
            return False
        return all(re.match(step, part) for step, part in zip(self.steps, parts))


@dataclass
class Folders(InputPartition):
    """A folder with all below it (``deep``) or its own files only, of which this is share ``part`` of ``parts``."""

    source: str
    folder: str
    deep: bool
    part: int = 0
    parts: int = 1


class FileRows(DataSource):
    """One row per file below the given paths: its facts, and its digest or content."""

    @classmethod
    def name(cls) -> str:
        return "fleetgauge_files"

    def schema(self) -> str:
        return COLUMNS[self.options.get("mode", "facts")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return FileReader(json.loads(self.options["paths"]), self.options.get("mode", "facts"), int(self.options.get("shares", "1")))


class FileReader(DataSourceReader):
    def __init__(self, paths: list[str], mode: str, shares: int) -> None:
        self.paths, self.mode, self.shares = paths, mode, shares

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for source in self.paths:
            store, path, _ = open_store(source)
            glob = Glob.of(path)
            kind = store.get_file_info(glob.root).type
            if kind == fs.FileType.NotFound:
                raise FileNotFoundError(source)
            if kind == fs.FileType.File:
                out.append(Folders(source, glob.root, False))
                continue
            waiting, looked = [glob.root], []
            # Breadth first, so that a tree of any shape is cut where it gets wide enough.
            while waiting and len(waiting) + len(looked) < FOLDERS:
                folder = waiting.pop(0)
                looked.append(folder)
                waiting += [x.path for x in store.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.Directory and glob.fits(x.path, False)]
            for deep, folders in ((False, looked), (True, waiting)):
                out += [Folders(source, f, deep, n, self.shares) for f in folders for n in range(self.shares)]
        return out or [Folders("", "", False)]

    def read(self, partition: Folders) -> Iterator[pa.RecordBatch]:
        if not partition.source:
            return
        store, path, prefix = open_store(partition.source)
        glob = Glob.of(path)
        kinds = pa.schema([("path", pa.string()), ("name", pa.string()), ("size_bytes", pa.int64()), ("modified", pa.timestamp("us", "UTC")),
                           ("hidden", pa.bool_()), ("read_error", pa.string())])
        if self.mode != "facts":
            kinds = kinds.append(pa.field(self.mode, pa.string() if self.mode == "sha256" else pa.binary()))
        rows, held = [], 0
        for info in self._files(store, glob, partition):
            name = info.path.rsplit("/", 1)[-1]
            row = [prefix + info.path, name, info.size, info.mtime, name[:1] in ("_", "."), None]
            if self.mode != "facts":
                try:
                    row.append(self._value(store, info))
                except (OSError, ValueError) as error:
                    row[5] = str(error)
                    row.append(None)
            rows.append(row)
            held += info.size if self.mode == "content" else 0
            if len(rows) >= BATCH_ROWS or held >= BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), kinds)], schema=kinds)

    def _files(self, store: fs.FileSystem, glob: Glob, partition: Folders) -> Iterator[fs.FileInfo]:
        if store.get_file_info(partition.folder).type == fs.FileType.File:
            yield store.get_file_info(partition.folder)
            return
        folders = [partition.folder]
        while folders:
            for info in store.get_file_info(fs.FileSelector(folders.pop())):
                if info.type == fs.FileType.Directory:
                    if partition.deep and glob.fits(info.path, False):
                        folders.append(info.path)
                elif not DRAFT.match(info.base_name) and glob.fits(info.path, True) and int(hashlib.sha256(info.path.encode()).hexdigest()[:8], 16) % partition.parts == partition.part:
                    yield info

    def _value(self, store: fs.FileSystem, info: fs.FileInfo) -> str | bytes:
        if self.mode == "content":
            if info.size > ROW_BYTES:
                raise ValueError("content is longer than a row")
            with store.open_input_stream(info.path) as stream:
                return stream.read()
        state = hashlib.sha256()
        with store.open_input_stream(info.path) as stream:
            while chunk := stream.read(CHUNK):
                state.update(chunk)
        return state.hexdigest()


def read_files(spark: SparkSession, paths: str | Sequence[str], mode: str = "facts", shares: int = 1) -> DataFrame:
    """Every file below ``paths`` (files, folders or globs), empty and hidden ones included.

    ``mode`` adds nothing (``facts``), ``sha256`` or ``content``.  A file that cannot be read, or
    whose content is longer than a row, has ``read_error`` and a null value.  ``shares`` deals
    the files of each folder to that many tasks; a missing path is an error.
    """
    spark.dataSource.register(FileRows)
    paths = [paths] if isinstance(paths, str) else list(paths)
    return spark.read.format(FileRows.name()).option("paths", json.dumps(paths)).option("mode", mode).option("shares", shares).load()


class FileSink(DataSource):
    """Rows (name, content) written as one file each below a folder."""

    @classmethod
    def name(cls) -> str:
        return "fleetgauge_file_sink"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return FileWriter(self.options["folder"])


class FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root, _ = open_store(self.folder)
        for batch in iterator:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                parts = (name or "").split("/")
                if any(p in ("", ".", "..") for p in parts):
                    raise ValueError(f"not a relative file name: {name!r}")
                folder = "/".join([root.rstrip("/"), *parts[:-1]])
                store.create_dir(folder, recursive=True)
                # A task that runs twice writes the same bytes under the same name; readers see whole files only.
                draft = f"{folder}/.{parts[-1]}.{uuid.uuid4().hex}"
                with store.open_output_stream(draft) as stream:
                    if content.is_valid:
                        stream.write(content.as_buffer())
                store.move(draft, f"{folder}/{parts[-1]}")
        return WriterCommitMessage()


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """Write each row's bytes to ``folder/name``; null content is an empty file, the last of equal names stays."""
    df.sparkSession.dataSource.register(FileSink)
    rows = df.selectExpr(f"cast(`{name}` as string) AS name", f"cast(`{content}` as binary) AS content")
    rows.write.format(FileSink.name()).option("folder", folder).mode("append").save()
