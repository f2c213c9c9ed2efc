"""Where intermediate tables go: the folder that all executors share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a new folder only in local mode without one."""
    sc = spark.sparkContext
    there = sc._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="graphweave-")
    sc.setCheckpointDir(wanted)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def unsized(df: DataFrame) -> DataFrame:
    """``df``, which has been cut, with a size that Spark does not know.

    A cut table keeps the size that was guessed from the input's; where code makes
    much of little, joins would send large tables through the driver.  Of tables of
    unknown size only those that shuffles have measured as small are broadcast.
    """
    spark, plan = df.sparkSession, df._jdf.queryExecution()
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), df._jdf.schema(), False), spark)


def sweep(spark: SparkSession) -> None:
    """Have Spark drop shuffle files, and checkpoints where they are cleaned up, that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def numbered(df: DataFrame, order: list, name: str = "index") -> DataFrame:
    """``df`` with the place of each row in a global order, from 0.

    Rows are range-partitioned and sorted; a place is the row's in its partition
    and the number of rows before that, of which the driver has one a partition.
    """
    rows = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    at = F.monotonically_increasing_id()  # partition << 33 | place in it
    rows = rows.withColumn("_p", F.shiftright(at, 33)).withColumn("_k", at.bitwiseAND(F.lit((1 << 33) - 1)))
    before, offsets = 0, []
    for r in sorted(rows.groupBy("_p").agg(F.count("*").alias("n")).collect()):
        offsets += [F.lit(r._p), F.lit(before)]
        before += r.n
    if not offsets:
        return df.withColumn(name, F.lit(0).cast("long"))
    return rows.withColumn(name, (F.col("_k") + F.element_at(F.create_map(*offsets), F.col("_p"))).cast("long")).drop("_p", "_k")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table or folder, in whatever store it is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file, whole; None if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.isFile(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """Folders that a glob names, in order, without their scheme where it is the local one; ** stands for one to three levels."""
    deep = [pattern.replace("**", "/".join(["*"] * n)) for n in (1, 2, 3)] if "**" in pattern else [pattern]
    found = set()
    for one in deep:
        p = spark._jvm.org.apache.hadoop.fs.Path(one)
        for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []:
            if s.isDirectory():
                at = s.getPath().toString()
                found.add("/" + at[len("file:") :].lstrip("/") if at.startswith("file:") and not pattern.startswith("file:") else at)
    return sorted(found)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
