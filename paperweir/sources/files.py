"""Files of a folder, their texts, and word lists."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from .formats import with_format
from .remote import system_of, there

# Fixed values.
ENCODINGS = ["utf-8-sig", "utf-8", "cp949", "euc-kr", "utf-16"]
LOSSY = "utf-8(일부 손실)"
EMPTY = "빈 파일입니다."


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files with a known extension: doc_id, path, name, length, modificationTime, content, ext, label, handler, error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    files = files.unionByName(without_bytes(spark, folder).select(files.columns))
    files = files.withColumns({"doc_id": F.sha2("path", 256), "name": F.regexp_extract("path", "([^/]*)$", 1)})
    return with_format(files).where("handler IS NOT NULL")


def without_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder that have no bytes, as the columns of ``binaryFile``, which passes them over: one task lists the folder.

    Names that begin with . or _ are hidden, as they are there.  Of a pattern, or of a file system that Arrow can't open, there are none.
    """
    head = re.match(r"([A-Za-z][\w+.-]*://[^/]*)?", folder)[0]
    head = "file:" if head in ("", "file://") else head

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            try:
                system, root = system_of(folder)
                found = [i for i in there(system, root, True) if i.type == fs.FileType.File and i.size == 0]
            except (OSError, pa.ArrowException):
                continue
            shown = [i for i in found if not any(part[:1] in (".", "_") for part in i.path[len(root) :].strip("/").split("/"))]
            # what an authority names is in the path of some file systems and not of others
            places = [head + "/" + i.path.lstrip("/") if head.endswith(":") or i.path.startswith("/") else folder.rstrip("/") + "/" + i.path[len(root) :].lstrip("/") for i in shown]
            columns = [pa.array(places, pa.string()), pa.array([i.mtime for i in shown], pa.timestamp("us", "UTC")), pa.array([0] * len(shown), pa.int64()), pa.array([b""] * len(shown), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["path", "modificationTime", "length", "content"])

    return spark.range(1, numPartitions=1).mapInArrow(run, "path string, modificationTime timestamp, length long, content binary")


# Fixed value: what is said of a file that was gone when it was to be read.
GONE = "파일을 읽지 못했습니다: "
# End of the fixed value.


def with_content(rows: DataFrame, path: str = "path") -> DataFrame:
    """``rows`` with ``content``, read by the tasks that hold them, and ``lost``, why a file couldn't be read."""
    kept = [c for c in rows.columns if c.lower() not in ("content", "lost")]
    schema = StructType([*(rows.schema[c] for c in kept), StructField("content", BinaryType()), StructField("lost", StringType())])
    at = kept.index(path)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data, lost = None, None
                try:
                    system, place = system_of(batch.column(at)[i].as_py())
                    with system.open_input_stream(place) as f:
                        data = f.read()
                except OSError as e:
                    lost = GONE + type(e).__name__
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, pa.array([data], pa.binary()), pa.array([lost], pa.string())], [*kept, "content", "lost"])

    return rows.select(*kept).mapInArrow(run, schema)


def listing(spark: SparkSession, folder: str, limit: int = 200) -> DataFrame:
    """The newest files; their content isn't read."""
    columns = ["path", "length", "modificationTime"]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(columns).unionByName(without_bytes(spark, folder).select(columns))
    rows = files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("size"), F.date_format("modificationTime", "MM-dd HH:mm").alias("modified"), "modificationTime")
    return rows.orderBy(F.desc("modificationTime"), "name").limit(limit).drop("modificationTime")


def decoded(content: Column) -> Column:
    """Text, encoding and error of bytes, by the first encoding that fits."""

    @pandas_udf(StructType([StructField(n, StringType()) for n in ("text", "encoding", "error")]))
    def run(column: pd.Series) -> pd.DataFrame:
        def one(data):
            if data is None or not bytes(data).strip():
                return None, None, EMPTY
            for name in ENCODINGS:
                try:
                    return bytes(data).decode(name), name, None
                except UnicodeDecodeError:
                    continue
            return bytes(data).decode("utf-8", "replace"), LOSSY, None

        return pd.DataFrame([one(x) for x in column], columns=["text", "encoding", "error"])

    return run(content)


def words(lines: DataFrame) -> DataFrame:
    """Words of a list, one a line; what follows # is a remark."""
    word = F.trim(F.element_at(F.split("value", "#"), 1))
    return lines.select(word.alias("word")).where("word <> ''").distinct()
