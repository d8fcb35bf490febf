"""Session helpers: the shared folder, lineage cuts and table loading."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local master, where one process does everything, may go without the setting; it then gets a temporary folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    found = "file://" + tempfile.mkdtemp(prefix="veridge-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, compression: str = "zstd", instead_of: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage and survives lost executors. Unlike ``checkpoint()`` it is columnar and compressed, and the copy has file sizes from which the planner sees what is small enough to broadcast. ``instead_of``, a table that was written before and that nothing but ``df`` reads, is deleted once ``df`` is whole, so that a loop keeps no more than its last state.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if instead_of is not None:
        drop_written(instead_of)
    return out


def drop_written(df: DataFrame) -> None:
    """Delete what ``written`` wrote for ``df``; other tables stay."""
    path = getattr(df, "_written_to", None)
    if path:
        spark = df.sparkSession
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a task of a dealt shuffle: a larger table gives more tasks, not larger ones.
TASK_ROWS = 1 << 19


def dealt(df: DataFrame, rows: int, *keys: Column | str) -> DataFrame:
    """``df``, of about ``rows`` rows, shuffled by ``keys`` before they are grouped or joined, in tasks of about ``TASK_ROWS`` rows.

    Adaptive execution merges partitions up to a size in bytes, of which rows with few repeats make several times as much in a hash table, and they make another before the shuffle. Tables too small for more tasks than there are cores are left to it.
    """
    n = -(-rows // TASK_ROWS)
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, order: list, name: str = "rank", partitions: int | None = None) -> DataFrame:
    """Number the rows of ``df`` from 0 in the given order without a single-task window.

    Rows are range-partitioned and written, so that partition limits cannot move between the passes; a count per partition gives the offsets, and each partition numbers its own rows. ``order`` must be a total order for a repeatable result. The offsets are one row per partition.
    """
    from pyspark.sql import Window

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).alias("__off"))
    in_part = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return (
        parts.withColumn("__rn", in_part)
        .join(F.broadcast(offsets), "__part")
        .withColumn(name, (F.col("__rn") - 1 + F.coalesce("__off", F.lit(0))).cast("long"))
        .drop("__part", "__rn", "__off")
    )
