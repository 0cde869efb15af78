"""Intermediate tables in the shared folder that the cluster names, and the steps in which tasks take large batches."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task works on at once; a longer text is a step of its own.
STEP_BYTES = 1 << 20

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; only where that is unset, and all runs in one process, a folder of one's own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-paperweir-")
        root = _own[app]
    return f"{root.rstrip('/')}/paperweir/{uuid.uuid4().hex}/{label}"


def stored(df: DataFrame, label: str, *by: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder, in folders by the columns ``by``, and read back."""
    path = shared_dir(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def steps(batch, column: str, size: int = STEP_BYTES):
    """An Arrow batch in slices whose texts or bytes have about ``size`` bytes and at least one row."""
    total = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64) + 1)
    first = 0
    while first < batch.num_rows:
        before = total[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(total, before + size, "right")))
        yield batch.slice(first, last - first)
        first = last
