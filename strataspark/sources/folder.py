"""A sink of whole files: each row (path, content) becomes a file of a folder that all machines share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Where attempts leave their files until the job commits.
_ATTEMPTS = "_attempts"


@dataclass
class _Written(WriterCommitMessage):
    attempt: str
    names: list[str]


def _opened(folder: str) -> tuple[fs.FileSystem, str]:
    """A file system and a path in it; folders without a scheme are paths of the machine."""
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder


def _checked(name: str | None) -> str:
    parts = (name or "").split("/")
    if any(p in ("", ".", "..") for p in parts) or parts[0] == _ATTEMPTS:
        raise ValueError(f"no relative path of a file: {name!r}")
    return name


class _Writer(DataSourceArrowWriter):
    """Task attempts write into folders of their own; committing moves the files of the attempts that count.

    A task that runs twice leaves nothing behind that counts, and a job that fails leaves no files.
    """

    def __init__(self, folder: str):
        self.folder, self.job = folder, uuid.uuid4().hex

    def _at(self, *parts: str) -> str:
        return "/".join([_opened(self.folder)[1].rstrip("/"), *parts])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        store, attempt, names = _opened(self.folder)[0], uuid.uuid4().hex, []
        for batch in iterator:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                target = self._at(_ATTEMPTS, self.job, attempt, _checked(name))
                store.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(target) as out:
                    out.write(content.as_buffer() if content.is_valid else b"")
                names.append(name)
        return _Written(attempt, names)

    def commit(self, messages: list[_Written | None]) -> None:
        store, seen = _opened(self.folder)[0], set()
        for m in messages:
            for name in m.names if m else []:
                if name in seen:
                    self.abort(messages)
                    raise ValueError(f"more than one file is named {name}")
                seen.add(name)
        for m in messages:
            for name in m.names if m else []:
                store.create_dir(self._at(name).rsplit("/", 1)[0], recursive=True)
                store.move(self._at(_ATTEMPTS, self.job, m.attempt, name), self._at(name))
        self._clean(store)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean(_opened(self.folder)[0])

    def _clean(self, store: fs.FileSystem) -> None:
        if store.get_file_info(self._at(_ATTEMPTS, self.job)).type == fs.FileType.Directory:
            store.delete_dir(self._at(_ATTEMPTS, self.job))
        left = store.get_file_info(fs.FileSelector(self._at(_ATTEMPTS), allow_not_found=True))
        if not left and store.get_file_info(self._at(_ATTEMPTS)).type == fs.FileType.Directory:
            store.delete_dir(self._at(_ATTEMPTS))


class FolderDataSource(DataSource):
    """Option path: the folder. Columns: path (relative to it) and content."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        if sorted(f.name for f in schema.fields) != ["content", "path"]:
            raise ValueError("the columns of a folder are path and content")
        return _Writer(self.options["path"])


def is_empty(folder: str) -> bool:
    """Whether a folder is missing or holds nothing."""
    store, path = _opened(folder)
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return True
    return not store.get_file_info(fs.FileSelector(path))


def write_files(files: DataFrame, folder: str, path: str = "path", content: str = "content", into_used: bool = False) -> None:
    """Writes each row's bytes (null: none) to a file; refuses a folder that holds anything, so that runs do not mix.

    Paths are relative, and no two rows may have the same. Files are written by tasks, and only a whole job's files appear.
    """
    if not into_used and not is_empty(folder):
        raise FileExistsError(f"the folder is not empty: {folder}")
    spark = files.sparkSession
    spark.dataSource.register(FolderDataSource)
    files.select(files[path].cast("string").alias("path"), files[content].cast("binary").alias("content")).write.format("folder").mode("append").save(folder)
