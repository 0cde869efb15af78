"""Results as files: one for each document, written by the tasks that hold them, to any file system that Arrow opens."""

from __future__ import annotations

import posixpath
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored

# Fixed values.
WARNING = "원문 개인정보가 들어 있습니다. 공유·커밋 금지."


def write_files(rows: DataFrame, folder: str, name: str, content: str) -> DataFrame:
    """Writes each row's ``content`` (text or bytes) to ``folder``/``name``; gives name and bytes of what was written.

    A file is written under another name and then moved, so a task that runs again, or twice, leaves one whole file.
    """

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        for batch in batches:
            sizes = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = posixpath.join(root, path)
                part = posixpath.join(posixpath.dirname(target), f".{uuid.uuid4().hex}.part")
                system.create_dir(posixpath.dirname(target), recursive=True)
                with system.open_output_stream(part) as out:
                    out.write(data)
                system.move(part, target)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["name", "bytes"])

    held = rows.where(F.col(name).isNotNull() & F.col(content).isNotNull()).select(F.col(name).alias("name"), F.col(content).cast("binary").alias("data"))
    return stored(held.mapInArrow(run, "name string, bytes long"), "written")


def write_markdown(converted: DataFrame, folder: str) -> DataFrame:
    """Markdown files of converted documents (out_name, text); those with an error have no text."""
    return write_files(converted, folder, "out_name", "text")


def write_pictures(pictures: DataFrame, folder: str) -> DataFrame:
    return write_files(pictures, folder, "path", "content")


def write_redacted(docs: DataFrame, made: dict[str, DataFrame], folder: str, reports: str, restricted: str | None = None) -> list[DataFrame]:
    """Masked texts and reports, which may be shared, and, only to a folder of its own, the mapping to the originals.

    docs has doc_id and out_name; made is what the engine's redaction gives.
    """
    if restricted is not None and restricted.rstrip("/") in (folder.rstrip("/"), reports.rstrip("/")):
        raise ValueError("The mapping holds the originals: give it a folder apart from those that are shared.")
    names = docs.select("doc_id", F.regexp_replace("out_name", r"\.md$", "").alias("stem"), F.col("out_name").alias("source"))

    def of(rows: DataFrame, ending: str, content) -> DataFrame:
        return rows.join(names, "doc_id").select(F.concat("stem", F.lit(ending)).alias("name"), content.alias("content"))

    out = [write_files(of(made["masked"], ".masked.md", F.col("masked_text")), folder, "name", "content"), write_files(of(made["report"], ".redact.json", F.col("report")), reports, "name", "content")]
    if restricted is not None:
        told = F.to_json(F.struct(F.lit(WARNING).alias("_warning"), "source", F.col("mapping").alias("map")))
        out.append(write_files(of(made["mapping"], ".mapping.json", told), restricted, "name", "content"))
    return out
