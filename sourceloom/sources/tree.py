"""Trees of files as a Spark data source, and a writer of one file per row.

Spark's own file sources pass over names that begin with a dot or an underscore, ``__init__.py`` among them, and list all
of a tree before anything is filtered. This source lists on the executors: planning opens directories only until there are enough of
them to share out, and each task walks its own. Excluded directories are named once and never entered.

Roots are local paths or whatever ``pyarrow.fs`` opens by its address (``file``, ``hdfs``, ``s3``, ``gs``); another scheme is an
error, no empty result. This module goes to the workers by value, so a cluster needs no copy of the package.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

NAME = "source_tree"
SCHEMA = "path string, kind string, version long, size long, content binary, error string"
BATCH_BYTES = 32_000_000


def opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a root and the root as that names it."""
    if "://" not in root and not root.startswith("file:"):
        return pafs.LocalFileSystem(), root.rstrip("/") or "/"
    if root.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + root[len("file:") :].strip("/")
    system, path = pafs.FileSystem.from_uri(root)
    return system, path.rstrip("/")


def entries(system: pafs.FileSystem, folder: str) -> list[pafs.FileInfo]:
    return sorted(system.get_file_info(pafs.FileSelector(folder)), key=lambda e: e.path)


class Share(InputPartition):
    """Directories of one task: (path, whether everything below belongs to it)."""

    def __init__(self, folders: list[tuple[str, bool]]):
        super().__init__(None)
        self.folders = folders


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.excluded = set(filter(None, options.get("excluded", "").split("/")))
        self.endings = tuple(filter(None, options.get("endings", "").lower().split("/")))
        self.read_content = options.get("content", "true") == "true"
        self.depth = int(options.get("repo_depth", "0"))  # directories above this depth are never excluded
        self.shares = int(options.get("shares", "64"))

    def level(self, path: str, base: str) -> int:
        return path[len(base) :].strip("/").count("/") if path != base else -1

    def entered(self, path: str, base: str) -> bool:
        return self.level(path, base) < self.depth or path.rsplit("/", 1)[-1] not in self.excluded

    def partitions(self) -> list[Share]:
        """Opens directories level by level until there are enough to share out."""
        system, base = opened(self.root)
        if system.get_file_info(base).type != pafs.FileType.Directory:
            raise FileNotFoundError(f"no directory: {self.root}")
        frontier, alone = [base], []
        while frontier and len(frontier) < 4 * self.shares:
            below = []
            for folder in frontier:
                alone.append((folder, False))
                found = (e.path for e in entries(system, folder) if e.type == pafs.FileType.Directory)
                below += [p for p in found if self.entered(p, base)]
            frontier = below
        folders = alone + [(f, True) for f in frontier]
        return [Share(folders[i :: self.shares]) for i in range(min(self.shares, len(folders)))]

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        system, base = opened(self.root)
        rows, held = [], 0
        pending = list(share.folders)
        while pending:
            folder, whole = pending.pop()
            for entry in entries(system, folder):
                path = entry.path[len(base) :].lstrip("/")
                if entry.type == pafs.FileType.Directory:
                    if not self.entered(entry.path, base):
                        rows.append((path, "excluded", None, None, None, None))
                    elif whole:
                        pending.append((entry.path, True))
                    continue
                version = None if entry.mtime_ns is None else entry.mtime_ns // 1000
                content = error = None
                if self.read_content:
                    if not entry.base_name.lower().endswith(self.endings or ("",)):
                        continue
                    try:
                        with system.open_input_stream(entry.path) as stream:
                            content = stream.read()
                        held += len(content)
                    except OSError as e:  # the file is gone or not ours to read: a row with the reason
                        error = f"read error: {type(e).__name__}"
                rows.append((path, "file", version, entry.size, content, error))
                if held >= BATCH_BYTES or len(rows) >= 10_000:
                    yield batch(rows)
                    rows, held = [], 0
        yield batch(rows)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    names = ["path", "kind", "version", "size", "content", "error"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options)


def read_tree(
    spark: SparkSession, root: str, excluded: list[str], repo_depth: int, endings: list[str] | None = None, shares: int = 64
) -> DataFrame:
    """Files below ``root`` with their paths from there, and a row of kind ``excluded`` per directory that is not entered.

    With ``endings``, contents of the files whose names end so (any case); without, all files and no contents.
    """
    spark.dataSource.register(TreeSource)
    reader = spark.read.format(NAME).option("excluded", "/".join(excluded)).option("repo_depth", repo_depth).option("shares", shares)
    reader = reader.option("content", endings is not None).option("endings", "/".join(endings or []))
    return reader.load(root)


def write_files(rows: DataFrame, root: str, path: str, content: str) -> DataFrame:
    """One file per row, written where its task runs: ``rows`` without ``content``, with ``status`` and ``reason``.

    A file appears whole under its name or not at all: it is written beside and then moved, so a repeated task puts the same file
    there again. What cannot be written is a row with status ``write error``. The result is to be written or counted
    once: each evaluation writes the files.
    """
    kept = [c for c in rows.columns if c != content]
    schema = StructType([rows.schema[c] for c in kept]).add("status", "string").add("reason", "string")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for part in batches:
            status, reason = [], []
            for name, text in zip(part[path].to_pylist(), part[content].to_pylist(), strict=True):
                try:
                    if name is None or text is None:
                        raise ValueError("no path or no content")
                    if ".." in name.split("/"):
                        raise ValueError("path leaves the root")
                    target = f"{base}/{name.lstrip('/')}"
                    folder, _, last = target.rpartition("/")
                    system.create_dir(folder, recursive=True)
                    beside = f"{folder}/.{last[:100]}.{uuid.uuid4().hex}.part"
                    with system.open_output_stream(beside) as out:
                        out.write(text if isinstance(text, bytes) else text.encode("utf-8", "surrogatepass"))
                    system.move(beside, target)
                    status.append("written")
                    reason.append(None)
                except (OSError, ValueError) as e:
                    status.append("write error")
                    reason.append(f"{type(e).__name__}: {e}"[:200] if isinstance(e, ValueError) else type(e).__name__)
            columns = [part[c] for c in kept] + [pa.array(status, pa.string()), pa.array(reason, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "status", "reason"])

    return rows.select(*kept, F.col(content)).mapInArrow(put, schema)
