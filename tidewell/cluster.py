"""What depends on the session: reliable cuts of the lineage, shared tables, partition counts, size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a plain local session without the setting gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewell-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost executor doesn't lose these rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a table in the shared folder. For large tables: columns compress, which the rows of a checkpoint don't."""
    return shared_table(df, "kept")


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def is_small(df: DataFrame, most_rows: int = 200_000) -> bool:
    return df.limit(most_rows + 1).count() <= most_rows


def small_side(df: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most_rows`` rows, else as it is for a shuffled join."""
    return F.broadcast(df) if is_small(df, most_rows) else df
