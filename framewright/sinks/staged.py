"""Files written with a commit: all of them appear when every task is done, or none.

``df.write.format("staged_files").option("root", ...)`` takes rows of ``path`` (below the root)
and ``data``.  A task writes its files and a list of them into a staging folder below the
root and tells the driver the list's name.  The commit gives the files their names, a list
at a time; an abort removes the staging folder with all that any attempt has left there.
A task that runs again, or twice at once, has its own list, and only the list of the
attempt that Spark takes is committed.  Spark does not wait for the tasks that still run when
it aborts: the folder is made once, before any task, with a mark in it; without the mark a
task does not begin, and one that ends removes what it has left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from framewright.sinks.png import encode_png
from framewright.sources.files import open_location

FORMAT = "staged_files"
RENAMES_AT_ONCE = 16
MARK = "._open"


@dataclass
class Written(WriterCommitMessage):
    """What a task has staged."""

    names: str
    files: int


class StagedWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.root = options["root"].rstrip("/")
        self.staging = f"{self.root}/._staging-{uuid.uuid4().hex}"
        fs, folder = open_location(self.staging)
        fs.create_dir(folder, recursive=True)
        fs.open_output_stream(f"{folder}/{MARK}").close()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        if not self._is_open():
            raise RuntimeError(f"the write to {self.root} has ended")
        try:
            return self._stage(iterator)
        finally:
            if not self._is_open():
                self._clear()

    def _stage(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = open_location(self.staging)
        attempt, paths = uuid.uuid4().hex, []
        for batch in iterator:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("data")):
                if path is None or not data.is_valid:
                    continue
                with fs.open_output_stream(f"{folder}/{attempt}-{len(paths)}.part") as out:
                    out.write(data.as_py())
                paths.append(path)
        with fs.open_output_stream(f"{folder}/{attempt}.json") as out:
            out.write(json.dumps(paths).encode())
        return Written(attempt, len(paths))

    def commit(self, messages: list) -> None:
        fs, folder = open_location(self.staging)
        _, root = open_location(self.root)
        made: set[str] = set()

        def name(job: tuple[str, str]) -> None:
            part, path = job
            fs.move(f"{folder}/{part}", f"{root}/{path}")

        with ThreadPoolExecutor(RENAMES_AT_ONCE) as pool:
            for message in messages:
                if message is None or not message.files:
                    continue
                with fs.open_input_stream(f"{folder}/{message.names}.json") as stream:
                    paths = json.loads(stream.read())
                parents = {f"{root}/{p}".rpartition("/")[0] for p in paths} - made
                list(pool.map(lambda d: fs.create_dir(d, recursive=True), sorted(parents)))
                made = parents  # tasks' folders overlap little; do not keep them all
                list(pool.map(name, ((f"{message.names}-{i}.part", p) for i, p in enumerate(paths))))
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _is_open(self) -> bool:
        fs, folder = open_location(self.staging)
        return fs.get_file_info(f"{folder}/{MARK}").type == pafs.FileType.File

    def _clear(self) -> None:
        fs, folder = open_location(self.staging)
        if fs.get_file_info(folder).type != pafs.FileType.Directory:
            return
        # Under another name no running task adds a file while the folder is emptied; stores
        # that rename no folders have none that must be empty.
        try:
            fs.move(folder, gone := f"{folder}-{uuid.uuid4().hex}")
        except (OSError, NotImplementedError):
            gone = folder
        if fs.get_file_info(gone).type == pafs.FileType.Directory:
            fs.delete_dir(gone)


class StagedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, data binary"

    def writer(self, schema, overwrite: bool) -> StagedWriter:
        return StagedWriter(self.options)


def write_staged(files: DataFrame, root: str) -> None:
    """Write ``data`` to ``root``/``path`` per row, all or nothing; rows without either are left out.
    Of rows with one path, one stays."""
    files.sparkSession.dataSource.register(StagedFiles)
    files.select("path", "data").write.format(FORMAT).mode("append").option("root", root).save()


def write_png_staged(images: DataFrame, path: Column, root: str) -> None:
    """Encode pixel rows and write them to ``path`` below ``root``, all or nothing."""
    write_staged(images.select(path.alias("path"), encode_png("px", "height", "width", "n_channels").alias("data")), root)
