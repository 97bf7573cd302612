"""Cutting lineage in a folder that all executors share, and joins that hot keys don't slow."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two short columns up to which a counted side is broadcast.
BROADCAST_ROWS = 1_000_000
#: A key is hot when it holds more than this share of the rows, so there are fewer hot keys than this.
HOT_SHARE = 4096
#: A key with fewer rows than this is never hot.
HOT_ROWS = 256

_doomed: set[str] = set()


def _remove_at_exit(spark: SparkSession, path: str) -> None:
    """Delete ``path`` when the driver's Python ends."""
    if path in _doomed:
        return
    _doomed.add(path)

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session may be gone already
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    atexit.register(remove)


def shared(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Only a local session without that setting gets a temporary folder; on a
    cluster such a folder would not be shared, so there it is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
            _remove_at_exit(spark, folder)
        sc.setCheckpointDir(folder)
    return sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()


def folder(spark: SparkSession, kind: str) -> str:
    """A new name below the shared folder; what is written there goes when the driver's Python ends."""
    path = f"{shared(spark)}/{kind}-{uuid.uuid4().hex}"
    _remove_at_exit(spark, path)
    return path


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    shared(spark)
    _remove_at_exit(spark, spark.sparkContext.getCheckpointDir())
    return df.checkpoint(eager=True)


def materialised(df: DataFrame) -> DataFrame:
    """A checkpoint whose size Spark takes for unknown, and so measures where it is joined.

    A checkpoint keeps the size that was guessed of its plan, in which a row
    that became thousands still counts as one; by that guess Spark broadcasts
    tables of any size.
    """
    kept = checkpoint(df)
    plan = kept._jdf.logicalPlan()
    return DataFrame(kept.sparkSession._jsparkSession.internalCreateDataFrame(plan.rdd(), plan.schema(), False), kept.sparkSession)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as Parquet, more compact than a checkpoint, and read again."""
    path = folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(df: DataFrame) -> DataFrame:
    """``df`` kept, and broadcast in joins only if its counted rows allow it; for narrow rows."""
    kept = materialised(df)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def spread(big: DataFrame, small: DataFrame, key: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small``, in which each ``key`` stands once, without a task for all rows of a hot key.

    Keys with more than 1 / ``HOT_SHARE`` of the rows are fewer than
    ``HOT_SHARE``, however large ``big`` is, so their rows of ``small`` are
    broadcast; all other keys are shuffled. Null keys match nothing; with
    ``how="left"`` their rows stay where they are. ``big`` is read twice, so it
    should be materialised. ``counts`` are the rows of ``big`` by key as column
    ``count``, where they are known already.
    """
    limit = max(HOT_ROWS, big.count() // HOT_SHARE)
    counts = big.groupBy(*key).count() if counts is None else counts
    hot = checkpoint(counts.where(F.col("count") > limit).select(*key).dropna())
    null = F.lit(False)
    for k in key:
        null = null | F.col(k).isNull()
    if how == "inner":
        if hot.isEmpty():
            return big.join(small, key)
        null = F.lit(False)
    tagged = big.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), key, "left")
    dense = F.col("__hot").isNotNull() | null
    few = small.join(F.broadcast(hot), key, "left_semi")
    return tagged.where(dense).drop("__hot").join(F.broadcast(few), key, how).unionByName(tagged.where(~dense).drop("__hot").join(small, key, how))
