"""Helpers the operators share: tables in the shared folder, free column names, grouped streams."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def stored(frame: DataFrame, label: str) -> DataFrame:
    """Write the frame to the shared folder and read it back: cuts lineage and outlives an executor."""
    path = f"{shared_folder(frame.sparkSession)}/llm-{label}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def free_name(frame: DataFrame, wanted: str) -> str:
    """A column name that the frame does not use yet."""
    used = {name.lower() for name in frame.columns}
    while wanted.lower() in used:
        wanted += "_"
    return wanted


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind an expensive array or string once and use it many times inside one expression."""
    return F.transform(F.array(value), body)[0]


def whole_text(column: str | Column) -> Column:
    """The text, a null as an empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cut a stream sorted by the keys into one table per key, also across batch borders.

    Only one group and one batch are held at a time.
    """
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        columns = [rows.column(k).to_pylist() for k in keys]
        start = 0
        for i, key in enumerate(zip(*columns)):
            if key == last:
                continue
            if i > start:
                held.append(rows.slice(start, i - start))
            if held:
                yield pa.concat_tables(held)
                held = []
            start, last = i, key
        if rows.num_rows > start:
            held.append(rows.slice(start))
    if held:
        yield pa.concat_tables(held)
