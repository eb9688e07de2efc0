"""Objects of a store as a stream, in key order, a small head first.

``spark.readStream.format("head_first_objects")`` gives the image objects below ``path`` in
the order of their keys ignoring case: the first trigger takes ``head`` of them, each later
one ``tail``.  An offset says which pass over the store it belongs to and the last key given.
A pass holds what was modified up to its beginning; what is added or changed later comes in
the next pass, in key order again, wherever its key falls, so nothing is passed over.

Folders are walked in key order, only from the last key on and only until a trigger is full;
the driver holds the folders on the way, never the listing.  Rows say where an object is;
tasks read it.

Options: ``path``; ``scope`` (a key prefix); ``head`` (20) and ``tail`` (1000) rows a trigger;
``settle`` (1000) milliseconds for which an object is left alone after a change, which has
to exceed the difference between the store's clock and the driver's.
"""

from __future__ import annotations

import heapq
import time
from collections.abc import Iterator
from itertools import groupby, islice

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from framewright.constants import IMAGE_EXTENSIONS
from framewright.sources.files import open_location

FORMAT = "head_first_objects"
_SUFFIXES = tuple(f".{e}" for e in IMAGE_EXTENSIONS)
SCHEMA = "key string, size long, modified_ms long, admission long, phase string"


def folded(text: str) -> str:
    """Lower case letter by letter, so that the fold of a key is that of its parts."""
    return "".join(c.lower() for c in text)


def in_order(key: str) -> tuple[str, str]:
    return folded(key), key


def walk(fs: pafs.FileSystem, root: str, folder: str = "", after: tuple[str, str] = ("", "")) -> Iterator[tuple[str, int, int]]:
    """(key, size, modified in ms) of objects below ``root/folder`` whose key comes after
    ``after``, in key order ignoring case.  Folders that end before ``after`` are not opened."""
    entries = fs.get_file_info(pafs.FileSelector(f"{root}/{folder}".rstrip("/"), allow_not_found=True))
    named = sorted((folded(e.base_name) + "/" * (e.type == pafs.FileType.Directory), e.base_name, e) for e in entries)
    for _, group in groupby(named, key=lambda n: n[0]):
        parts = []
        for _, name, e in group:
            key = f"{folder}{name}"
            if e.type == pafs.FileType.Directory:
                inside = folded(key) + "/"
                if after[0] < inside or after[0].startswith(inside):
                    parts.append(walk(fs, root, key + "/", after))
            elif e.type == pafs.FileType.File and in_order(key) > after:
                parts.append(iter([(key, e.size, e.mtime_ns // 1_000_000)]))
        # Folders whose names differ in case only share their places in the order.
        yield from heapq.merge(*parts, key=lambda o: in_order(o[0])) if len(parts) > 1 else (o for p in parts for o in p)


class HeadFirstReader(SimpleDataSourceStreamReader):
    """An offset is {since, until: the pass's bounds in ms; fold, key: the last key; admission: triggers so far}."""

    def __init__(self, options: dict):
        self.path, self.scope = options["path"].rstrip("/"), options.get("scope", "")
        self.head, self.tail = int(options.get("head", 20)), int(options.get("tail", 1000))
        self.settle = int(options.get("settle", 1000))
        if self.head < 1 or self.tail < 1:
            raise ValueError("head and tail have to be positive")

    def initialOffset(self) -> dict:
        return {"since": -1, "until": -1, "fold": "", "key": "", "admission": 0}

    def _objects(self, since: int, until: int, after: tuple[str, str]) -> Iterator[tuple[str, int, int]]:
        fs, root = open_location(self.path)
        for key, size, modified in walk(fs, root.rstrip("/"), after=after):
            if since < modified <= until and key.startswith(self.scope) and key.lower().endswith(_SUFFIXES):
                yield key, size, modified

    def _rows(self, objects, admission: int) -> list[tuple]:
        phase = "head" if admission == 0 else "tail"
        return [(*o, admission, phase) for o in objects]

    def read(self, start: dict):
        """Rows of the next trigger: the rest of the pass, else the beginning of a new one."""
        room = self.head if start["admission"] == 0 else self.tail
        found = list(islice(self._objects(start["since"], start["until"], (start["fold"], start["key"])), room)) if start["until"] >= 0 else []
        since, until = start["since"], start["until"]
        if not found:
            since, until = until, int(time.time() * 1000) - self.settle
            found = list(islice(self._objects(since, until, ("", "")), room)) if until > since else []
        if not found:
            return iter([]), start
        fold, key = in_order(found[-1][0])
        end = {"since": since, "until": until, "fold": fold, "key": key, "admission": start["admission"] + 1}
        return iter(self._rows(found, start["admission"])), end

    def readBetweenOffsets(self, start: dict, end: dict):
        """The same rows again, for a batch that is run once more."""
        if start == end:
            return iter([])
        same_pass = start["until"] == end["until"]
        after, last = ((start["fold"], start["key"]) if same_pass else ("", "")), (end["fold"], end["key"])
        objects = []
        for o in self._objects(end["since"], end["until"], after):
            if in_order(o[0]) > last:
                break
            objects.append(o)
        return iter(self._rows(objects, start["admission"]))


class HeadFirstObjects(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> HeadFirstReader:
        return HeadFirstReader(self.options)


def head_first_objects(spark: SparkSession, path: str, head: int = 20, tail: int = 1000, scope: str = "", settle_ms: int = 1000):
    """The stream of image objects below ``path``."""
    spark.dataSource.register(HeadFirstObjects)
    return spark.readStream.format(FORMAT).options(path=path, head=head, tail=tail, scope=scope, settle=settle_ms).load()
