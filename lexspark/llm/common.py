"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; a folder of our own only where it names none on one machine, as in tests."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    Lost executors cost no recomputation, and the planner sees the table's true size: a checkpoint would carry the estimate
    of the plan behind it on, which multiplies with every join of a loop.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a lookup table that go to every task at once, whatever the corpus.
SMALL = 1 << 17


def meet(left: DataFrame, right: DataFrame, keys: list[str], right_rows: int, how: str = "inner", share: int = 256, small: int = SMALL) -> DataFrame:
    """``left`` joined with ``right``, which has at most one row a key, without a task that holds a hot key.

    ``right_rows`` is an upper bound of ``right``'s rows: up to ``small`` of them are broadcast.  Beyond that, keys that more than
    one in ``share`` rows of ``left`` have, of which there can be at most ``share``, are counted first (by partial sums
    before the shuffle) and only their rows of ``right`` are broadcast; all other rows meet in a shuffle.  ``left`` is then read
    several times: hand in a table.
    """
    if right_rows <= small:
        return left.join(F.broadcast(right), keys, how)
    n = left.count()
    heavy = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max(1, n // share)).orderBy(F.desc("_n")).drop("_n").limit(share).collect()
    if not heavy:
        return left.join(right, keys, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(heavy, left.select(*keys).schema))
    near = left.join(hot, keys, "left_semi").join(F.broadcast(right.join(hot, keys, "left_semi")), keys, how)
    return near.unionByName(left.join(hot, keys, "left_anti").join(right, keys, how))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of ``df`` has, in any case of letters."""
    held, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in held:
            n += "_"
        out.append(n)
    return out


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n."""
    return F.crc32(doc_id.cast("string")) % n


def shuffled(doc_id: Column) -> Column:
    """A fixed order that has nothing to do with the ids."""
    return F.xxhash64(doc_id.cast("string"), F.lit("sample"))


def thinned(df: DataFrame, key: Column, want: int, total: Column | int) -> DataFrame:
    """About twice ``want`` of ``total`` rows, those with the smallest ``key`` (a hash), or all if there are fewer.

    A bounded sample is then taken from what is left: without this, every task would send ``want`` rows.
    """
    share = F.least(F.lit(1.0), F.lit(2.0 * want + 100) / F.greatest(F.lit(1), total if isinstance(total, Column) else F.lit(total)))
    return df.where((key / F.lit(2.0**64) + 0.5) <= share)
