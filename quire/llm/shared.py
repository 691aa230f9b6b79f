"""Where lineage is cut: a reliable checkpoint in the folder that the cluster names."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    Only a local session that names no folder gets one of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("name a shared folder in spark.checkpoint.dir")
            named = tempfile.mkdtemp(prefix="spark-ckpt-", dir="/tmp")
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it from there."""
    import uuid

    spark = df.sparkSession
    cut(spark.range(0))  # names the folder, if the session has none yet
    path = f"{spark.sparkContext.getCheckpointDir()}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
