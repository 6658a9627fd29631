"""Documents as files: a Spark data source that reads and writes one row per file.

```python
spark.dataSource.register(DocumentSource)
spark.read.format("documents").option("root", "/shared/docs").load()
spark.read.format("documents").option("manifest", "/shared/paths").load()
rows.write.format("documents").option("root", "/shared/docs").mode("append").save()
```

Reading knows three ways to name files; each gives groups of paths, a group for each task:

- `paths`: a JSON array of paths.
- `manifest`: a file, or a folder of text files, with a path in each line. Tasks read ranges of its bytes, so the
  driver sees neither the paths nor their number.
- `root`: the files right below the root and right below its folders, with one of `suffixes`. The driver lists the
  root once; tasks list the folders.

A file that cannot be read is a row too, with `error` and without content; undecodable bytes are replaced. A path
with a scheme goes to that store as far as Arrow knows it, any other to the file system that all machines mount.
Writing puts every row's content below the root under its relative path, by way of another name, so a repeated task
leaves the same files.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceArrowWriter, InputPartition, WriterCommitMessage

import gradeloom

# Ship this package with the source, so workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(gradeloom)

SCHEMA = "path string, folder string, file_name string, content string, size bigint, error string"
NOT_FOUND = "not found"
#: Defaults of the options: paths of a task, bytes of a manifest for a task, files read at once, bytes handed on together.
PATHS_PER_TASK, MANIFEST_BYTES, CONCURRENCY, BATCH_BYTES = 256, 1 << 18, 8, 8_000_000

_FIELDS = pa.schema([("path", pa.string()), ("folder", pa.string()), ("file_name", pa.string()), ("content", pa.string()), ("size", pa.int64()), ("error", pa.string())])


def store_of(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Paths(InputPartition):
    paths: list[str]
    folder: str | None = None


@dataclass
class ManifestRange(InputPartition):
    path: str
    start: int
    end: int


@dataclass
class Folders(InputPartition):
    folders: list[str]


def manifest_lines(store: pafs.FileSystem, path: str, start: int, end: int) -> Iterator[str]:
    """Lines that begin in the range; the one that reaches beyond it is read to its end."""
    with store.open_input_file(path) as f:
        size, held = f.size(), b""
        at = max(start - 1, 0)
        f.seek(at)
        begun = start == 0
        while at < size:
            data = f.read(min(1 << 16, size - at))
            at += len(data)
            *lines, held = (held + data).split(b"\n")
            place = at - len(held) - sum(len(x) + 1 for x in lines)
            for line in lines:
                if begun and place >= end:
                    return
                if begun and line:
                    yield line.decode()
                begun, place = True, place + len(line) + 1
        if begun and held and at - len(held) < end:
            yield held.decode()


def read_file(path: str, folder: str | None = None, content: bool = True) -> tuple:
    """A row of the source."""
    name = posixpath.basename(path.rstrip("/"))
    try:
        store, own = store_of(path)
        info = store.get_file_info(own)
        if info.type != pafs.FileType.File:
            return path, folder, name, None, None, NOT_FOUND if info.type == pafs.FileType.NotFound else "not a file"
        if not content:
            return path, folder, name, None, info.size, None
        with store.open_input_file(own) as f:
            return path, folder, name, f.read().decode("utf-8", errors="replace"), info.size, None
    except FileNotFoundError:  # gone since it was listed
        return path, folder, name, None, None, NOT_FOUND
    except (OSError, pa.ArrowException) as exc:
        return path, folder, name, None, None, f"{type(exc).__name__}: {str(exc)[:200]}"


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        given = [k for k in ("paths", "manifest", "root") if options.get(k)]
        if len(given) != 1:
            raise ValueError("name the files by one of the options paths, manifest and root")
        self.by, self.value = given[0], options[given[0]] if given[0] == "paths" else options[given[0]].rstrip("/")
        self.per_task = int(options.get("pathsPerTask", PATHS_PER_TASK))
        self.manifest_bytes = int(options.get("manifestBytes", MANIFEST_BYTES))
        self.concurrency = int(options.get("concurrency", CONCURRENCY))
        self.content = options.get("content", "true").lower() == "true"
        self.suffixes = tuple(s for s in options.get("suffixes", "").split(",") if s)

    def partitions(self) -> list[InputPartition]:
        if self.by == "paths":
            paths = json.loads(self.value)
            return [Paths(paths[k : k + self.per_task]) for k in range(0, len(paths), self.per_task)]
        store, own = store_of(self.value)
        scheme = self.value[: len(self.value) - len(own)] if self.value.endswith(own) else ""
        if self.by == "manifest":
            info = store.get_file_info(own)
            files = store.get_file_info(pafs.FileSelector(own)) if info.type == pafs.FileType.Directory else [info]
            files = [f for f in files if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
            step = self.manifest_bytes
            return [ManifestRange(scheme + f.path, k, min(k + step, f.size)) for f in files for k in range(0, f.size, step)]
        found = store.get_file_info(pafs.FileSelector(own, allow_not_found=True))
        files = sorted(scheme + f.path for f in found if f.type == pafs.FileType.File and self._wanted(f.base_name))
        folders = sorted(scheme + f.path for f in found if f.type == pafs.FileType.Directory)
        n = self.per_task
        return [*(Paths(files[k : k + n]) for k in range(0, len(files), n)), *(Folders(folders[k : k + n]) for k in range(0, len(folders), n))]

    def _wanted(self, name: str) -> bool:
        return not name.startswith(("_", ".")) and (not self.suffixes or name.endswith(self.suffixes))

    def _named(self, partition: InputPartition) -> Iterator[tuple[str, str | None]]:
        """(path, folder) of the files of a partition."""
        if isinstance(partition, Paths):
            yield from ((p, None) for p in partition.paths)
        elif isinstance(partition, ManifestRange):
            store, own = store_of(partition.path)
            yield from ((p, None) for p in manifest_lines(store, own, partition.start, partition.end))
        elif isinstance(partition, Folders):
            for folder in partition.folders:
                store, own = store_of(folder)
                scheme = folder[: len(folder) - len(own)]
                for f in store.get_file_info(pafs.FileSelector(own, allow_not_found=True)):
                    if f.type == pafs.FileType.File and self._wanted(f.base_name):
                        yield scheme + f.path, posixpath.basename(own)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        named = self._named(partition)
        with ThreadPoolExecutor(self.concurrency) as pool:
            while group := [x for _, x in zip(range(4 * self.concurrency), named)]:
                for row in pool.map(lambda x: read_file(*x, self.content), group):
                    rows.append(row)
                    held += row[4] or 0
                    if held >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)], schema=_FIELDS)


@dataclass
class Written(WriterCommitMessage):
    files: int


class DocumentWriter(DataSourceArrowWriter):
    """Rows of path (relative to the root) and content (string or binary; null is empty)."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = store_of(self.root)
        made, files = set(), 0
        for batch in iterator:
            contents = batch.column(batch.schema.get_field_index("content")).cast(pa.binary())
            for path, content in zip(batch.column(batch.schema.get_field_index("path")).to_pylist(), contents.to_pylist(), strict=True):
                if not path or posixpath.isabs(path) or ".." in path.split("/"):
                    raise ValueError(f"not a path below the root: {path!r}")
                target = f"{base}/{path}"
                folder = posixpath.dirname(target)
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                own = f"{folder}/_{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(content or b"")
                store.move(own, target)
                files += 1
        return Written(files)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "documents"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DocumentReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite or not self.options.get("root"):
            raise ValueError("documents are written in append mode, below the option root")
        return DocumentWriter(self.options["root"])


def read_files(spark: SparkSession, **options: str) -> DataFrame:
    """A row for each file named by `paths`, `manifest` or `root`: path, folder, file_name, content, size, error."""
    spark.dataSource.register(DocumentSource)
    return spark.read.format("documents").options(**options).load()


def write_files(rows: DataFrame, root: str) -> None:
    """Rows (path, content) as files below `root`; a file that stands there is replaced."""
    rows.sparkSession.dataSource.register(DocumentSource)
    rows.select("path", "content").write.format("documents").option("root", root).mode("append").save()


def write_manifest(paths: DataFrame, folder: str) -> None:
    """The distinct paths (column path), a line each. A path cannot hold a line break here; such a path names no file."""
    paths.select("path").filter(F.col("path").isNotNull() & ~F.contains("path", F.lit("\n"))).distinct().write.text(folder)
