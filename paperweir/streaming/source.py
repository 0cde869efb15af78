"""The inbox as a stream source: each poll gives a row for every file that is there."""

from __future__ import annotations

import posixpath
import time
from collections.abc import Iterator
from datetime import datetime, timezone

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.remote import by_value, mark, system_of, there

SCHEMA = "path string, name string, size long, modified timestamp, at timestamp, blocked boolean"


def hidden(path: str) -> bool:
    return any(part.startswith((".", "_")) for part in path.split("/"))


class Part(InputPartition):
    """A poll of the files of the folder itself, or of all under some of its folders."""

    def __init__(self, at: int, folders: list[str] | None) -> None:
        self.at, self.folders = at, folders


class Polls(DataSourceStreamReader):
    """Offsets are times of polls.  A poll that is made again lists the folder again: a row says what was seen, whenever that was."""

    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.blocked = options["path"], options.get("blocked")
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.every = float(options.get("everySeconds", "0"))
        self.parts = int(options.get("parts", "64"))
        self.told = 0

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self, *_) -> dict:
        now = int(time.time() * 1000)
        if now - self.told >= self.every * 1000:
            self.told = now
        return {"at": self.told}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        """The files beside each other are one part; folders are dealt out to the others, and only tasks look into them."""
        found = [Part(end["at"], None)]
        if self.recursive:
            system, root = system_of(self.folder)
            folders = [i.path for i in there(system, root) if i.type == fs.FileType.Directory and not hidden(i.base_name)]
            found += [Part(end["at"], folders[k :: self.parts]) for k in range(min(self.parts, len(folders)))]
        return found

    def read(self, part: Part) -> Iterator[tuple]:
        system, root = system_of(self.folder)
        at = datetime.fromtimestamp(part.at / 1000, timezone.utc)
        prefix = self.folder[: len(self.folder) - len(root)] if self.folder.endswith(root) else ""
        marks = set()
        if self.blocked:
            held, place = system_of(self.blocked)
            marks = {i.base_name for i in there(held, place)}
        for folder in [root] if part.folders is None else part.folders:
            for info in there(system, folder, part.folders is not None):
                inner = posixpath.relpath(info.path, root)
                if info.type == fs.FileType.File and not hidden(inner):
                    yield prefix + info.path, info.base_name, info.size, info.mtime, at, mark(inner) in marks

    def commit(self, end: dict) -> None:
        pass


class Inbox(DataSource):
    """``spark.readStream.format("paperweir_inbox").option("path", folder).load()``: path, name, size, modified, at and blocked.

    Options: ``recursive`` (true), ``everySeconds`` (a poll at most so often; 0), ``parts`` (tasks that look into folders; 64) and
    ``blocked``, a folder whose file names are the ``mark`` of files that are to be left alone until they are gone.
    Files and folders whose names begin with a dot or an underscore are left out.
    """

    @classmethod
    def name(cls) -> str:
        return "paperweir_inbox"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> Polls:
        return Polls(self.options)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session."""
    by_value(__name__)
    spark.dataSource.register(Inbox)
