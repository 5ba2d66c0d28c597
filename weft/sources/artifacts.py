"""A source and sink of run artifacts with a "latest" pointer that moves once, when a whole run is written.

``df.write.format("artifact").mode("append").save(folder)`` writes a run in two phases.  Every
task writes the rows of its partition to a file of its own attempt and tells the driver about it.
When all have, the driver's commit writes the run's manifest, with the files of the attempts that
count and their totals, and only then replaces ``latest.json``.  A job that fails leaves the pointer where it was
and takes its files away.  Reading takes the run that the pointer names, or the one in the option ``run``.

Rows are JSON lines; columns may be strings, whole numbers, doubles and booleans.  With the option ``text`` the
named column is also written as a plain text file, and the manifest counts its characters and words.
Paths are those of pyarrow's file systems (plain paths, file:, s3:, gs:, hdfs:).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

POINTER, MANIFEST = "latest.json", "manifest.json"
KINDS = ("string", "long", "integer", "double", "boolean")


@dataclass
class Written(WriterCommitMessage):
    """One task's file and what is in it."""

    file: str
    rows: int
    chars: int
    words: int


@dataclass
class ArtifactFile(InputPartition):
    path: str


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_json(files: fs.FileSystem, path: str) -> dict:
    with files.open_input_stream(path) as f:
        return json.loads(f.read())


def write_json(files: fs.FileSystem, path: str, value: dict) -> None:
    """The whole value or nothing: it is written beside its place and then moved."""
    beside = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(beside) as f:
        f.write(json.dumps(value, sort_keys=True).encode())
    files.move(beside, path)


def latest(folder: str) -> dict | None:
    """The manifest of the run that the pointer names; None before the first run."""
    files, root = opened(folder)
    if files.get_file_info(f"{root}/{POINTER}").type == fs.FileType.NotFound:
        return None
    return read_json(files, f"{root}/runs/{read_json(files, f'{root}/{POINTER}')['run']}/{MANIFEST}")


class ArtifactWriter(DataSourceWriter):
    def __init__(self, folder: str, run: str, columns: list[str], text: str | None):
        self.folder, self.run, self.columns, self.text = folder, run, columns, text

    def write(self, iterator: Iterator) -> Written:
        files, root = opened(self.folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        home = f"{root}/runs/{self.run}"
        files.create_dir(home, recursive=True)
        rows = chars = words = 0
        plain = files.open_output_stream(f"{home}/{name}.txt") if self.text else None
        with files.open_output_stream(f"{home}/{name}.json") as f:
            for row in iterator:
                f.write((json.dumps(dict(zip(self.columns, row)), ensure_ascii=False) + "\n").encode())
                rows += 1
                if plain:
                    text = row[self.columns.index(self.text)] or ""
                    plain.write((text + "\n").encode())
                    chars, words = chars + len(text), words + len(text.split())
        if plain:
            plain.close()
        return Written(f"{name}.json", rows, chars, words)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = opened(self.folder)
        parts = [m for m in messages if m is not None]
        totals = {k: sum(asdict(m)[k] for m in parts) for k in ("rows", "chars", "words")}
        files.create_dir(f"{root}/runs/{self.run}", recursive=True)
        write_json(files, f"{root}/runs/{self.run}/{MANIFEST}", {"run": self.run, "files": [m.file for m in parts], "columns": self.columns, **totals})
        write_json(files, f"{root}/{POINTER}", {"run": self.run})

    def abort(self, messages: list[Written | None]) -> None:
        files, root = opened(self.folder)
        home = f"{root}/runs/{self.run}"
        if files.get_file_info(home).type == fs.FileType.Directory:
            files.delete_dir(home)


class ArtifactReader(DataSourceReader):
    def __init__(self, folder: str, run: str | None, columns: list[str]):
        self.folder, self.run, self.columns = folder, run, columns

    def partitions(self) -> list[ArtifactFile]:
        files, root = opened(self.folder)
        manifest = read_json(files, f"{root}/runs/{self.run}/{MANIFEST}") if self.run else latest(self.folder)
        if manifest is None:
            raise ValueError(f"no run has been written to {self.folder}")
        return [ArtifactFile(f"{root}/runs/{manifest['run']}/{name}") for name in manifest["files"]]

    def read(self, partition: ArtifactFile) -> Iterator[tuple]:
        files, _ = opened(self.folder)
        with files.open_input_stream(partition.path) as f:
            rest = b""
            while chunk := f.read(1 << 20):
                *lines, rest = (rest + chunk).split(b"\n")
                for line in lines:
                    row = json.loads(line)
                    yield tuple(row.get(c) for c in self.columns)


class ArtifactSource(DataSource):
    """``format("artifact")``, once ``register`` has been called on the session."""

    @classmethod
    def name(cls) -> str:
        return "artifact"

    def schema(self) -> str:
        raise ValueError("name the columns: spark.read.format('artifact').schema(...)")

    def folder(self) -> str:
        return self.options["path"].rstrip("/")

    def checked(self, schema: StructType) -> list[str]:
        if odd := [f.name for f in schema.fields if f.dataType.typeName() not in KINDS]:
            raise ValueError(f"columns {odd} are none of {KINDS}")
        return schema.names

    def writer(self, schema: StructType, overwrite: bool) -> ArtifactWriter:
        return ArtifactWriter(self.folder(), self.options.get("run") or uuid.uuid4().hex, self.checked(schema), self.options.get("text"))

    def reader(self, schema: StructType) -> ArtifactReader:
        return ArtifactReader(self.folder(), self.options.get("run"), self.checked(schema))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArtifactSource)
