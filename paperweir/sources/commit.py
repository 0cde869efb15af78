"""Files that are written whole or not at all: a sink in two phases, with a ledger of what each batch has written."""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .remote import by_value, exists, mark, system_of, there

#: What a row brings: its document, the files that it becomes, the source file (path, and its place in the inbox), its format and what went wrong.
ROW = "doc_id string, source string, inner string, format string, error string, files array<struct<name:string,content:binary>>"
ENTRY = "batch long, doc_id string, source string, inner string, format string, error string, names array<string>, state string, at double"
#: Times that a source is tried to be moved, and the seconds between.
TRIES, PAUSE = 3, 0.6


def put(system: fs.FileSystem, path: str, data: bytes) -> None:
    """Writes a file under another name and moves it, so that nobody sees a part of it."""
    system.create_dir(posixpath.dirname(path), recursive=True)
    part = posixpath.join(posixpath.dirname(path), f".{uuid.uuid4().hex}.part")
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)


def remove(system: fs.FileSystem, folder: str) -> None:
    if exists(system, folder):
        system.delete_dir(folder)


def free(system: fs.FileSystem, path: str) -> str:
    """The path, or with _1, _2, .. before its ending if it is taken."""
    stem, ending = posixpath.splitext(path)
    n, name = 0, path
    while exists(system, name):
        n += 1
        name = f"{stem}_{n}{ending}"
    return name


@dataclass
class Staged(WriterCommitMessage):
    """The list of what one task has written; None if it had nothing to write."""

    manifest: str | None


class Writer(DataSourceWriter):
    """Tasks write below ``.staging``; the driver's commit puts down which lists count, and then moves.

    Phase 1, in tasks: files, and a list of them.  A task that dies leaves only staged files.  Phase 2, in the driver: one file in
    the ledger, ``<batch>/<id>.json``, names the lists; from then on the batch is decided, and what follows may be done again
    from any point.  Files are moved to their names, sources to done or failed; where a source can't be moved, its files are taken back
    and it is marked as blocked.  A batch that is written again skips the documents that the ledger has of it.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.out, self.ledger, self.batch = options["path"].rstrip("/"), options["ledger"].rstrip("/"), int(options["batch"])
        self.done, self.failed, self.blocked = options.get("done"), options.get("failed"), options.get("blocked")

    def _stage(self, root: str) -> str:
        return posixpath.join(root, ".staging", str(self.batch))

    def write(self, rows: Iterator) -> Staged:
        held, ledger = system_of(self.ledger)
        known = {e["doc_id"] for e in entries(held, ledger, self.batch)}
        system, root = system_of(self.out)
        stage = posixpath.join(self._stage(root), uuid.uuid4().hex)
        told = []
        for k, row in enumerate(rows):
            if row["doc_id"] in known:
                continue
            pairs = []
            for i, file in enumerate(row["files"] or []):
                place = posixpath.join(stage, f"{k}-{i}")
                system.create_dir(stage, recursive=True)
                with system.open_output_stream(place) as out:
                    out.write(bytes(file["content"]))
                pairs.append([place, file["name"]])
            told.append({"doc_id": row["doc_id"], "source": row["source"], "inner": row["inner"], "format": row["format"], "error": row["error"], "files": pairs})
        if not told:
            return Staged(None)
        manifest = posixpath.join(stage, "list.json")
        put(system, manifest, "\n".join(json.dumps(t) for t in told).encode())
        return Staged(manifest)

    def commit(self, messages: list[Staged | None]) -> None:
        held, ledger = system_of(self.ledger)
        lists = [m.manifest for m in messages if m and m.manifest]
        if lists:
            put(held, posixpath.join(ledger, str(self.batch), f"{uuid.uuid4().hex}.json"), json.dumps({"lists": lists, "options": self.options()}).encode())
        finish(self.ledger)
        system, root = system_of(self.out)
        remove(system, self._stage(root))

    def abort(self, messages: list[Staged | None]) -> None:
        system, root = system_of(self.out)
        remove(system, self._stage(root))

    def options(self) -> dict:
        return {"out": self.out, "batch": self.batch, "done": self.done, "failed": self.failed, "blocked": self.blocked}


def entries(system: fs.FileSystem, ledger: str, batch: int) -> list[dict]:
    """What the ledger has of one batch."""
    found = []
    for info in there(system, posixpath.join(ledger, str(batch))):
        if info.base_name.endswith(".jsonl"):
            with system.open_input_stream(info.path) as f:
                found += [json.loads(line) for line in f.read().decode().splitlines()]
    return found


def finish(ledger: str) -> None:
    """Carries out every decided batch that isn't finished: a decision becomes entries once all its moves are made."""
    held, root = system_of(ledger)
    for info in there(held, root, True):
        if info.type == fs.FileType.File and info.path.endswith(".json") and not info.base_name.startswith("."):
            after = info.path + "l"
            if not exists(held, after):
                with held.open_input_stream(info.path) as f:
                    decided = json.loads(f.read())
                put(held, after, "\n".join(json.dumps(e) for e in carried(**decided)).encode())
            held.delete_file(info.path)


def carried(lists: list[str], options: dict) -> Iterator[dict]:
    """Moves what the lists name; each move that was made already is passed over."""
    system, root = system_of(options["out"])
    for place in lists:
        with system.open_input_stream(place) as f:
            told = [json.loads(line) for line in f.read().decode().splitlines()]
        for t in told:
            targets = [posixpath.join(root, name) for _, name in t["files"]]
            for (staged, _), target in zip(t["files"], targets, strict=True):
                if exists(system, staged):
                    system.create_dir(posixpath.dirname(target), recursive=True)
                    if exists(system, target):
                        system.delete_file(target)
                    system.move(staged, target)
            state = "failed" if t["error"] is not None else "done"
            if t["source"] and options[state] and not moved(t["source"], t["inner"] or posixpath.basename(t["source"]), options[state]):
                for target in targets:
                    if exists(system, target):
                        system.delete_file(target)
                state = "blocked"
                if options["blocked"]:
                    marks, folder = system_of(options["blocked"])
                    put(marks, posixpath.join(folder, mark(t["inner"] or posixpath.basename(t["source"]))), (t["inner"] or "").encode())
            yield {"batch": options["batch"], **{c: t[c] for c in ("doc_id", "source", "inner", "format", "error")}, "names": [name for _, name in t["files"]], "state": state, "at": time.time()}


def moved(source: str, inner: str, folder: str) -> bool:
    """Moves a file; False if it can't be moved.  One that is gone counts as moved: the move may have been made before."""
    system, place = system_of(source)
    there, root = system_of(folder)
    for n in range(TRIES):
        try:
            if not exists(system, place):
                return True
            target = free(there, posixpath.join(root, inner))
            there.create_dir(posixpath.dirname(target), recursive=True)
            system.move(place, target)
            return True
        except OSError:
            if n + 1 < TRIES:
                time.sleep(PAUSE)
    return False


class Files(DataSource):
    """``rows.write.format("paperweir_files")``, see ``ROW``; options path, ledger, batch and, for sources, done, failed and blocked."""

    @classmethod
    def name(cls) -> str:
        return "paperweir_files"

    def schema(self) -> str:
        return ROW

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options)


def register(spark: SparkSession) -> None:
    by_value(__name__)
    spark.dataSource.register(Files)


def write(rows: DataFrame, path: str, ledger: str, batch: int, **folders: str | None) -> None:
    """Writes rows (see ``ROW``) as one batch; ``folders`` are done, failed and blocked."""
    register(rows.sparkSession)
    finish(ledger)
    options = {"path": path, "ledger": ledger, "batch": str(batch)} | {k: v for k, v in folders.items() if v}
    rows.select(*(F.col(c) for c in ("doc_id", "source", "inner", "format", "error", "files"))).write.format("paperweir_files").mode("append").options(**options).save()


def history(spark: SparkSession, ledger: str) -> DataFrame:
    """A row for each document of each finished batch."""
    held, root = system_of(ledger)
    if not any(i.path.endswith(".jsonl") for i in there(held, root, True)):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").json(ledger)


def progress(spark: SparkSession, ledger: str, errors: int = 300) -> dict[str, DataFrame]:
    """How far a stream has come: ``formats`` (processed, failed and blocked files of each format) and ``errors`` (the latest, newest first)."""
    rows = history(spark, ledger)
    state = F.col("state")
    by_format = rows.groupBy("format").agg(F.count_if(state == "done").alias("processed"), F.count_if(state == "failed").alias("failed"), F.count_if(state == "blocked").alias("blocked"))
    last = rows.where("state <> 'done'").select("source", "state", "error", "batch", F.timestamp_micros((F.col("at") * 1e6).cast("long")).alias("at"))
    return {"formats": by_format, "errors": last.orderBy(F.desc("at"), "source").limit(errors)}
