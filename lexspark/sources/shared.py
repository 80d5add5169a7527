"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only where it names none on one machine, as in tests."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM for a folder."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def new_folder(spark: SparkSession, name: str = "scratch") -> str:
    """A folder of its own below the shared one; it is removed when the driver's session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    fs, hadoop = file_system(spark, path)
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def remove(spark: SparkSession, path: str) -> None:
    fs, hadoop = file_system(spark, path)
    fs.delete(hadoop, True)


def numbered_folders(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers n of the folders ``kind=n`` below ``path`` that were written to their end, in order."""
    fs, hadoop = file_system(spark, path)
    if not fs.exists(hadoop):
        return []
    out = []
    for status in fs.listStatus(hadoop):
        name = status.getPath().getName()
        if name.startswith(f"{kind}=") and fs.exists(file_system(spark, f"{path}/{name}/_SUCCESS")[1]):
            out.append(int(name.split("=")[1]))
    return sorted(out)


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there: lineage and size estimates start anew, and lost executors cost no recomputation."""
    path = f"{new_folder(df.sparkSession, 'cut')}/t"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str, rows: int = 1 << 20) -> DataFrame:
    """``df`` dealt by ``keys`` for the windows that follow: where the session's partitions would hold more than ``rows`` rows each, over more of them."""
    n = -(-df.count() // rows)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a join's side that is never gathered for a broadcast: files that compress well would pass for a small table."""
    return df.hint("merge")


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """``rows`` with ``name``: the row number within ``by`` in ``order``, which must tell all rows of a group apart.

    Rows are dealt by ranges of (by, order), so a group that holds a large part of all rows is spread over many tasks; each counts its own
    part and moves on by what the parts before it hold.
    """
    at = "_range"
    held = cut(rows.repartitionByRange(*by, *order).withColumn(at, F.spark_partition_id()))
    counts = held.groupBy(*by, at).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col(at).alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    met = F.col(at) == F.col("_at")
    for i, b in enumerate(by):
        met = met & F.col(b).eqNullSafe(F.col(f"_by{i}"))
    local = held.withColumn(name, F.row_number().over(Window.partitionBy(*by, at).orderBy(*order)))
    return local.join(counts, met).withColumn(name, F.col(name) + F.col("_before")).drop(at, "_at", "_before", *[f"_by{i}" for i in range(len(by))])
