"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id where ids are compared: it sorts after all others.
LAST_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one, but only if one machine does all the work."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="linkloom-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and any executor can be lost afterwards."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def forget(settled: DataFrame) -> None:
    """Delete a table that settle() wrote and that no later job reads."""
    jvm, jsc = settled.sparkSession._jvm, settled.sparkSession.sparkContext._jsc
    path = jvm.org.apache.hadoop.fs.Path(settled.settled_at)
    path.getFileSystem(jsc.hadoopConfiguration()).delete(path, True)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n."""
    return F.crc32(F.col(f"`{column}`").cast("string").cast("binary")) % n


def unused(name: str, *frames: DataFrame) -> str:
    """name, or a longer one that no column of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
