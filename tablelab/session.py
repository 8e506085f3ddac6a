"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, types as T
from pyspark.sql.pandas.types import to_arrow_type

_local_folders: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def local_session(cores: str | int = "*", app: str = "tablelab") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("TABLELAB_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only a local session may go without it."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="tablelab-")
    return _local_folders[app]


def materialise(df: DataFrame, label: str, split_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used after a full shuffle whose result several passes read. The written
    table survives the loss of executors and keeps column pruning, which a
    cached row set would not. ``split_by`` columns become folders, so that a
    filter on them reads only its share.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/tablelab/{label}-{uuid.uuid4().hex}"
    _written.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.partitionBy(*split_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """The rows shuffled, for :func:`materialise` before work that is heavy for each row.

    A table of few bytes comes in few splits, which are too few tasks for such
    work. Rows are dealt by all their columns: only copies of a row meet.
    """
    return df.repartition(*["`" + c.replace("`", "``") + "`" for c in df.columns])


def written(spark: SparkSession) -> list[str]:
    """The folders that :func:`materialise` has written for this application, in order."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, folders: Sequence[str] | None = None) -> None:
    """Delete the intermediate tables that :func:`materialise` wrote for this application, or only ``folders`` of them.

    Write or collect results first: what has not been computed from these tables is lost.
    """
    app = spark.sparkContext.applicationId
    gone = _written.get(app, []) if folders is None else [f for f in folders if f in _written.get(app, [])]
    _written[app] = [f for f in _written.get(app, []) if f not in set(gone)]
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(hadoop).delete(folder, True)


def small_table(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """A few result rows as a local relation, without tasks of its own."""
    schema = T.StructType.fromDDL(ddl)
    cells = [[v.item() if isinstance(v, np.generic) else v for v in row] for row in rows]
    arrays = [
        pa.array([row[i] for row in cells], type=to_arrow_type(f.dataType)) for i, f in enumerate(schema.fields)
    ]
    return spark.createDataFrame(pa.table(arrays, names=schema.names), schema=schema)


def hold(df: DataFrame) -> DataFrame:
    """A result table of a bounded number of rows, computed once."""
    return small_table(df.sparkSession, [tuple(r) for r in df.collect()], df.schema.toDDL())
