"""Written tables that cut lineage.

``stage`` writes a DataFrame as Parquet below the shared folder that the
cluster names in ``spark.checkpoint.dir`` and reads it back: a lost executor
costs a re-read, never a recomputation, and every later reader of the table
sees the same rows. ``free`` deletes single tables as soon as their last reader
is written, ``release`` all that this session has staged.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from crawlfold.session import ensure_checkpoint_dir

_STAGED: dict[str, list[str]] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/llm-{name}-{uuid.uuid4().hex[:12]}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a scan of the written table."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def free(*tables: DataFrame) -> None:
    """Delete staged tables that no DataFrame will read again."""
    for table in tables:
        spark = table.sparkSession
        _delete(spark, [table._staged_at])
        _STAGED.get(spark.sparkContext.applicationId, []).remove(table._staged_at)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete what was written at ``path``, a ``shared_path`` that nothing will read again."""
    _delete(spark, [path])
    _STAGED.get(spark.sparkContext.applicationId, []).remove(path)


def _delete(spark: SparkSession, paths: list[str]) -> int:
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def release(spark: SparkSession) -> int:
    """Delete the tables this application staged; call it once their readers
    are done. Returns the number of paths deleted."""
    return _delete(spark, _STAGED.pop(spark.sparkContext.applicationId, []))
