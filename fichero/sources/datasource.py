"""Files of a folder, decoded by a plug-in, as a source of Spark's own: spark.read and spark.readStream, format "fichero_files".

    register(spark)
    spark.read.format("fichero_files").option("decoder", "package.module:function").option("columns", "text string").load("/data/bronze")

A decoder takes a file's bytes and yields rows of the columns. Every row carries doc_key, path, the time of the file's last
change and `error`; a file that fails gives one row with its error and stops no other. Options: decoder, columns,
pattern (of names, "*" by default), partitionBytes (files of about so many bytes a task, 16 MB by default).

Folders are read through Arrow's file systems, so local paths, hdfs:// and s3:// work. The stream's offset is the
mark of the latest change taken in; files that come or change later are the next batch.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "fichero_files"
PARTITION_BYTES = 16 << 20
_OWN = ["doc_key string", "path string", "changed timestamp"]


@dataclass
class Files(InputPartition):
    """Files that one task reads: (path, nanoseconds of the last change)."""

    files: list[tuple[str, int]]


def _decoder(name: str) -> Callable[[bytes], Iterator[tuple]]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _Folder:
    """What batch and stream readers share."""

    def __init__(self, options: dict, width: int):
        self.options, self.width = dict(options), width

    def _system(self):
        from pyarrow import fs

        path = self.options["path"]
        return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)

    def listed(self, after: int = -1, to: int | None = None) -> list[tuple[str, int, int]]:
        """(path, last change, size) of the files that fit the pattern and changed in (after, to], in order of change."""
        from pyarrow import fs

        system, root = self._system()
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        pattern = self.options.get("pattern", "*")
        named = [(f.path, f.mtime_ns or 0, f.size or 0) for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, pattern)]
        return sorted((x for x in named if x[1] > after and (to is None or x[1] <= to)), key=lambda x: (x[1], x[0]))

    def planned(self, files: list[tuple[str, int, int]]) -> list[Files]:
        """Files dealt to tasks of about partitionBytes; Spark reads one partition at least."""
        most, out, held = int(self.options.get("partitionbytes", PARTITION_BYTES)), [[]], 0
        for path, changed, size in files:
            if out[-1] and held + size > most:
                out.append([])
                held = 0
            out[-1].append((path, changed))
            held += size
        return [Files(part) for part in out]

    def rows(self, partition: Files) -> Iterator[tuple]:
        system, _ = self._system()
        decoder = _decoder(self.options["decoder"])
        for path, changed in partition.files:
            own = (path.rsplit("/", 1)[-1].rsplit(".", 1)[0], path, datetime.fromtimestamp(changed / 1e9, timezone.utc))
            try:
                with system.open_input_stream(path) as f:
                    rows = [(*own, *r, None) for r in decoder(f.read())]
            except Exception as e:  # noqa: BLE001  a broken file must not stop the others
                rows = [(*own, *[None] * self.width, f"{type(e).__name__}: {e}")]
            yield from rows


class _Reader(_Folder, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.planned(self.listed())

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)


class _StreamReader(_Folder, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        files = self.listed()
        return {"changed": files[-1][1] if files else -1}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        return self.planned(self.listed(start["changed"], end["changed"]))

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None: ...


class FicheroFiles(DataSource):
    """Format "fichero_files"."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def _columns(self) -> list[str]:
        return [c.strip() for c in self.options["columns"].split(",")]

    def schema(self) -> str:
        return ", ".join([*_OWN, *self._columns(), "error string"])

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, len(self._columns()))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options, len(self._columns()))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FicheroFiles)


def text_of(content: bytes) -> Iterator[tuple]:
    """Decoder of plain text in UTF-8."""
    yield (content.decode("utf-8"),)
