"""The inbox as a stream source, the state of its files, and the sink that commits."""

import datetime as dt
import json
import os
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from paperweir.plans import engine
from paperweir.sources import commit, remote
from paperweir.streaming import inbox, source

POLL = "path string, name string, size long, modified timestamp, at timestamp, blocked boolean"


def wait(query, test, seconds=90):
    end = time.time() + seconds
    while time.time() < end:
        if query.exception():
            raise query.exception()
        if test():
            return True
        time.sleep(0.3)
    return False


def test_settled_stream_is_settled(spark, tmp_path):
    """The state over many batches gives what the windows give over the whole log."""
    start = dt.datetime(2024, 1, 1)
    sizes = {"a": [5, 5, 5, 5, 5], "b": [1, 2, 3, 3, 3, 3, 3], "c": [1, 1, 1, None, None, 1, 1, 1, 1], "d": [2, 2, 4, 4, 4, 4, 2, 2, 2, 2], "e": [None, 0, 0, 0, 7], "f": [9, None, 9, None, 9, 9, 9]}
    log = [(n, n, s, None, start + dt.timedelta(seconds=2 * k), None) for n, row in sizes.items() for k, s in enumerate(row)]
    for k in range(10):
        part = [r for r in log if r[4] == start + dt.timedelta(seconds=2 * k)]
        spark.createDataFrame(part, POLL).coalesce(1).write.parquet(str(tmp_path / "log" / f"p{k}"))
        for f in (tmp_path / "log" / f"p{k}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    got = []
    polls = spark.readStream.schema(POLL).option("maxFilesPerTrigger", 3).option("recursiveFileLookup", "true").parquet(str(tmp_path / "log"))
    query = inbox.settled_stream(polls, 3.0).writeStream.foreachBatch(lambda b, _: got.extend(b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0 seconds").start()
    try:
        assert wait(query, lambda: len(got) >= 8)
    finally:
        query.stop()
    want = inbox.settled(spark.createDataFrame([(r[1], r[4], r[2]) for r in log], "name string, ts timestamp, size long"), 3.0).collect()
    assert sorted((r["name"], r["size"], r["since"], r["ready"]) for r in got) == sorted(tuple(r) for r in want) and len(got) == 8


def test_restarts_repeat_nothing_and_a_dropped_again_file_is_new(spark, tmp_path):
    """Three runs over one checkpoint; a file that comes again while no poll looked is read again."""
    folder = tmp_path / "in"
    (folder / "deep" / "er").mkdir(parents=True)
    (folder / "a.txt").write_text("first", encoding="utf-8")
    (folder / "deep" / "er" / "b.txt").write_text("inner", encoding="utf-8")
    (folder / ".part.txt").write_text("hidden", encoding="utf-8")
    (folder / "x.bin").write_text("unknown", encoding="utf-8")
    seen = []

    def run(test):
        query = engine.stream(spark, str(folder), lambda df, n: seen.extend(r["blocks"][0]["text"] for r in df.collect()), str(tmp_path / "cp"), stable=0.5)
        try:
            assert wait(query, test), seen
            batch = query.lastProgress["batchId"] if query.lastProgress else 0
            assert wait(query, lambda: query.lastProgress and query.lastProgress["batchId"] > batch + 1)
        finally:
            query.stop()

    run(lambda: len(seen) == 2)
    assert sorted(seen) == ["first", "inner"]
    run(lambda: True)
    assert sorted(seen) == ["first", "inner"]
    (folder / "a.txt").unlink()
    (folder / "a.txt").write_text("again", encoding="utf-8")  # the same length, never seen gone
    run(lambda: len(seen) == 3)
    assert sorted(seen) == ["again", "first", "inner"]


def test_state_is_dropped_when_a_file_goes(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("x", encoding="utf-8")
    (folder / "b.txt").write_text("y", encoding="utf-8")
    blocked = tmp_path / "blocked"
    blocked.mkdir()
    (blocked / remote.mark("b.txt")).write_text("")
    got = []
    rows = engine.settled_files(spark, str(folder), stable=0.2, blocked=str(blocked), forget=4.0)
    query = rows.writeStream.foreachBatch(lambda b, _: got.extend(r["inner"] for r in b.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    held = lambda: {r[0] for r in spark.read.format("statestore").option("stateVarName", "seen").load(str(tmp_path / "cp")).where("value IS NOT NULL").select("key.path").collect()}
    try:
        assert wait(query, lambda: got == ["a.txt"])
        assert {Path(p).name for p in held()} == {"a.txt", "b.txt"}
        (folder / "a.txt").unlink()
        assert wait(query, lambda: {Path(p).name for p in held()} == {"b.txt"})
        assert got == ["a.txt"]
    finally:
        query.stop()


ROWS = "doc_id string, source string, inner string, format string, error string, files array<struct<name:string,content:binary>>"


def names(folder):
    return sorted(str(p.relative_to(folder)) for p in Path(folder).rglob("*") if p.is_file() and not p.name.endswith(".crc"))


def test_a_batch_is_written_once(spark, tmp_path):
    inn, out, ledger, done, failed = (tmp_path / x for x in ("in", "out", "ledger", "done", "failed"))
    inn.mkdir(), done.mkdir()
    for n in ("a.txt", "b.txt", "c.txt"):
        (inn / n).write_text(n)
    (done / "a.txt").write_text("taken")
    rows = spark.createDataFrame([
        ("1", str(inn / "a.txt"), "a.txt", "txt", None, [("a.md", b"A"), ("assets/a/img1.png", b"P")]),
        ("2", str(inn / "b.txt"), "b.txt", "txt", "bad", None),
    ], ROWS).repartition(2)
    folders = {"done": str(done), "failed": str(failed)}
    commit.write(rows, str(out), str(ledger), 7, **folders)
    assert names(out) == ["a.md", "assets/a/img1.png"] and names(done) == ["a.txt", "a_1.txt"] and names(failed) == ["b.txt"] and names(inn) == ["c.txt"]
    (out / "a.md").write_text("changed since")
    third = spark.createDataFrame([("3", str(inn / "c.txt"), "c.txt", "txt", None, [("c.md", b"C")])], ROWS)
    commit.write(rows.unionByName(third), str(out), str(ledger), 7, **folders)
    assert (out / "a.md").read_text() == "changed since" and (out / "c.md").read_text() == "C" and names(done) == ["a.txt", "a_1.txt", "c.txt"]
    assert {(r["doc_id"], r["state"], tuple(r["names"])) for r in commit.history(spark, str(ledger)).collect()} == {("1", "done", ("a.md", "assets/a/img1.png")), ("2", "failed", ()), ("3", "done", ("c.md",))}
    told = commit.progress(spark, str(ledger))
    assert [tuple(r) for r in told["formats"].collect()] == [("txt", 2, 1, 0)] and [r["error"] for r in told["errors"].collect()] == ["bad"]
    assert not (out / ".staging" / "7").exists()


def test_a_task_that_dies_leaves_nothing(spark, tmp_path):
    inn, out, ledger = (tmp_path / x for x in ("in", "out", "ledger"))
    inn.mkdir()
    (inn / "a.txt").write_text("a")

    @F.udf("binary")
    def late(x):
        if x == 3:
            raise RuntimeError("killed between write and commit")
        return b"whole"

    content = F.array(F.struct(F.concat(F.col("id").cast("string"), F.lit(".md")).alias("name"), late("id").alias("content")))
    rows = spark.range(4).repartition(2, "id").select(F.col("id").cast("string").alias("doc_id"), F.lit(str(inn / "a.txt")).alias("source"), F.lit("a.txt").alias("inner"), F.lit("txt").alias("format"), F.lit(None).cast("string").alias("error"), content.alias("files"))
    with pytest.raises(Exception, match="killed"):
        commit.write(rows, str(out), str(ledger), 1, done=str(tmp_path / "done"))
    assert names(out) == [] and names(ledger) == [] and names(inn) == ["a.txt"]
    assert commit.history(spark, str(ledger)).count() == 0


def test_a_decided_batch_is_finished_later(tmp_path):
    """The driver dies after the decision, at any point of the moves."""
    for point in range(3):
        root = tmp_path / str(point)
        inn, out, ledger, done = (root / x for x in ("in", "out", "ledger", "done"))
        for d in (inn, out, ledger, done):
            d.mkdir(parents=True)
        (inn / "a.txt").write_text("a")
        writer = commit.Writer({"path": str(out), "ledger": str(ledger), "batch": "4", "done": str(done)})
        message = writer.write(iter([{"doc_id": "1", "source": str(inn / "a.txt"), "inner": "a.txt", "format": "txt", "error": None, "files": [{"name": "a.md", "content": b"A"}]}]))
        staged = json.loads(Path(message.manifest).read_text())["files"][0][0]
        (ledger / "4").mkdir()
        (ledger / "4" / "x.json").write_text(json.dumps({"lists": [message.manifest], "options": writer.options()}))
        if point > 0:
            os.rename(staged, out / "a.md")
        if point > 1:
            os.rename(inn / "a.txt", done / "a.txt")
        commit.finish(str(ledger))
        commit.finish(str(ledger))
        assert (out / "a.md").read_text() == "A" and names(done) == ["a.txt"] and names(inn) == [] and names(ledger) == ["4/x.jsonl"]


def test_a_source_that_cannot_be_moved_takes_its_files_back(tmp_path, monkeypatch):
    inn, out, ledger, done, blocked = (tmp_path / x for x in ("in", "out", "ledger", "done", "blocked"))
    inn.mkdir()
    (inn / "a.txt").write_text("a")
    done.write_text("a file where the folder should be")
    monkeypatch.setattr(commit, "PAUSE", 0.01)
    writer = commit.Writer({"path": str(out), "ledger": str(ledger), "batch": "1", "done": str(done), "blocked": str(blocked)})
    writer.commit([writer.write(iter([{"doc_id": "1", "source": str(inn / "a.txt"), "inner": "a.txt", "format": "txt", "error": None, "files": [{"name": "a.md", "content": b"A"}]}]))])
    assert names(out) == [] and names(inn) == ["a.txt"] and names(blocked) == [remote.mark("a.txt")]


def test_a_stream_to_folders(spark, tmp_path):
    inn = tmp_path / "in"
    (inn / "sub").mkdir(parents=True)
    (inn / "a.txt").write_text("hello", encoding="utf-8")
    (inn / "sub" / "a.txt").write_text("inner", encoding="utf-8")
    (inn / "bad.json").write_text("{", encoding="utf-8")
    folders = {k: str(tmp_path / k) for k in ("out", "ledger", "done", "failed", "blocked")}
    query = engine.stream(spark, str(inn), folders, str(tmp_path / "cp"), stable=0.3)
    try:
        assert wait(query, lambda: names(inn) == [], 120), names(inn)
        (inn / "a.txt").write_text("hello again", encoding="utf-8")
        assert wait(query, lambda: names(inn) == [], 120)
    finally:
        query.stop()
    assert names(tmp_path / "done") == ["a.txt", "a_1.txt", "sub/a.txt"] and names(tmp_path / "failed") == ["bad.json"]
    texts = sorted(Path(tmp_path / "out" / n).read_text(encoding="utf-8").rsplit("---", 1)[1].strip() for n in names(tmp_path / "out"))
    assert texts == ["hello", "hello again", "inner"]
    told = {r["format"]: (r["processed"], r["failed"]) for r in commit.progress(spark, folders["ledger"])["formats"].collect()}
    assert told == {"txt": (3, 0), "json": (0, 1)}


def test_parts_of_a_poll(tmp_path):
    for n in ("a.txt", "x/b.txt", "y/z/c.txt", ".hid/d.txt", "x/_tmp/e.txt"):
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text("1")
    reader = source.Polls({"path": str(tmp_path), "parts": "2"})
    rows = [r for p in reader.partitions({"at": 0}, {"at": 5000}) for r in reader.read(p)]
    assert sorted(os.path.relpath(r[0], tmp_path) for r in rows) == ["a.txt", "x/b.txt", "y/z/c.txt"] and all(r[2] == 1 and not r[5] for r in rows)
    assert len(list(source.Polls({"path": str(tmp_path), "recursive": "false"}).read(source.Part(1, None)))) == 1
