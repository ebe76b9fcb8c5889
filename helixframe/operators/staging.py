"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_local: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table under spark.checkpoint.dir: its lineage is cut, and lost executors lose nothing of it.

    Where that setting is unset, a local master writes to a temporary folder of the process; any other raises.
    """
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _local:
            _local.append(f"file://{tempfile.mkdtemp(prefix='spark-')}")
        root = _local[0]
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
