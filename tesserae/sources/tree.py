"""A data source of class trees: files under split/class, written by tasks and committed at once, and listed by class folder.

    spark.dataSource.register(ClassTree)
    rows.write.format("classtree").mode("overwrite").option("path", root).save()   # split, class, filename, content
    spark.read.format("classtree").option("path", root).option("extensions", ".txt,.md").load()

Tasks write into a folder of their own version; the commit replaces one small file that says which version each class folder
has, so a write is seen whole or not at all, replaces only the class folders it has rows for, and costs the driver nothing that
grows with the files. A failed write leaves the tree as it was. Any file system that Arrow knows by its URI can hold a tree.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

POINTER = "_versions.json"
BATCH = 1024


def _at(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def versions(root: str) -> dict[str, str]:
    """Class folders (split/class) and where their files are."""
    system, base = _at(root)
    path = posixpath.join(base, POINTER)
    if system.get_file_info(path).type == fs.FileType.NotFound:
        return {}
    with system.open_input_stream(path) as f:
        return json.loads(f.read())


def _point(root: str, known: dict[str, str]) -> None:
    system, base = _at(root)
    system.create_dir(base, recursive=True)
    fresh = posixpath.join(base, f"{POINTER}.{uuid.uuid4().hex}")
    with system.open_output_stream(fresh) as f:
        f.write(json.dumps(known, sort_keys=True).encode())
    system.move(fresh, posixpath.join(base, POINTER))


@dataclass
class Folder(InputPartition):
    split: str
    cls: str
    path: str


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.root, self.columns = options["path"], schema.names
        self.extensions = tuple(e.strip().lower() for e in options.get("extensions", "").split(",") if e.strip())

    def partitions(self) -> list[Folder]:
        return [Folder(*key.split("/", 1), path) for key, path in sorted(versions(self.root).items())]

    def read(self, folder: Folder) -> Iterator[pa.RecordBatch]:
        """The files of one class folder; contents are opened only where the column is asked for."""
        if folder is None:
            return
        system, base = _at(self.root)
        listed = system.get_file_info(fs.FileSelector(posixpath.join(base, folder.path)))
        # a name that starts with an underscore belongs to a task that has not ended
        found = sorted((f for f in listed if f.type == fs.FileType.File and not f.base_name.startswith("_") and (not self.extensions or f.base_name.lower().endswith(self.extensions))), key=lambda f: f.base_name.lower())
        for at in range(0, len(found), BATCH):
            some = found[at : at + BATCH]
            columns = {
                "path": lambda: pa.array([f"{folder.split}/{folder.cls}/{f.base_name}" for f in some], pa.string()), "split": lambda: pa.array([folder.split] * len(some), pa.string()),
                "class": lambda: pa.array([folder.cls] * len(some), pa.string()), "filename": lambda: pa.array([f.base_name for f in some], pa.string()),
                "length": lambda: pa.array([f.size for f in some], pa.int64()), "content": lambda: pa.array([self._content(system, f.path) for f in some], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays([columns[c]() for c in self.columns], names=self.columns)

    @staticmethod
    def _content(system: fs.FileSystem, path: str) -> bytes:
        with system.open_input_stream(path) as f:
            return f.read()


@dataclass
class Written(WriterCommitMessage):
    folders: list[str]


class TreeWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], overwrite: bool) -> None:
        self.root, self.version, self.overwrite = options["path"], f"v-{uuid.uuid4().hex}", overwrite

    def write(self, rows: Iterator[Row]) -> Written:
        """One file a row; it gets its name once it is whole, so a second attempt of a task writes the same files again."""
        system, base = _at(self.root)
        folders: set[str] = set()
        for row in rows:
            folder = f"{row['split']}/{row['class']}"
            if any(not part or part in (".", "..") or "/" in part for part in (row["split"], row["class"], row["filename"])):
                raise ValueError(f"no name of a file in a class tree: {folder}/{row['filename']}")
            target = posixpath.join(base, self.version, folder)
            if folder not in folders:
                system.create_dir(target, recursive=True)
                folders.add(folder)
            fresh = posixpath.join(target, f"_{uuid.uuid4().hex}")
            with system.open_output_stream(fresh) as f:
                f.write(row["content"] or b"")
            system.move(fresh, posixpath.join(target, row["filename"]))
        return Written(sorted(folders))

    def commit(self, messages: list[Written | None]) -> None:
        """Class folders that were written point to the new version; without overwrite, folders that exist are an error."""
        new = {folder: f"{self.version}/{folder}" for m in messages if m is not None for folder in m.folders}
        known = versions(self.root)
        if not self.overwrite and known.keys() & new.keys():
            self.abort(messages)
            raise ValueError(f"class folders exist: {sorted(known.keys() & new.keys())[:5]}")
        _point(self.root, {**known, **new})

    def abort(self, messages: list[Written | None]) -> None:
        system, base = _at(self.root)
        target = posixpath.join(base, self.version)
        if system.get_file_info(target).type == fs.FileType.Directory:
            system.delete_dir(target)


class ClassTree(DataSource):
    """Options: path, and for reading the comma-separated extensions to list (any case; all where there are none)."""

    @classmethod
    def name(cls) -> str:
        return "classtree"

    def schema(self) -> str:
        return "path string, split string, class string, filename string, length long, content binary"

    def reader(self, schema: StructType) -> TreeReader:
        return TreeReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(self.options, overwrite)
