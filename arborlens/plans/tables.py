"""Loading the parquet tables of a data folder, staging intermediate results, and joins and numbering that no hot key can hold up."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Into how many parts the rows of a key are dealt where one key may hold a third of all rows.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of the folder `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir` of the session, or the checkpoint folder it was given. Only a session whose executors are threads of this
    machine (tests, local mode) may do without: a temporary folder takes its place. On a cluster that is an error, since executors would write to
    disks that others can't read."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master is {master})")
    base = tempfile.mkdtemp(prefix="arborlens-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(base)
    return base


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write `df` to the shared folder and read it back: lineage ends there, columns can still be pruned, and the loss of
    an executor costs nothing that was staged."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(there)  # when the application ends
    return spark.read.schema(df.schema).parquet(path)


def salted_join(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner", salts: int = SALTS) -> DataFrame:
    """`rows` joined with `few`, which has few rows for each key: the rows of a key are dealt into `salts` parts by their content, and the few rows
    repeated for each part, so no task gets all rows of a hot key."""
    every = [F.col(c) for c in rows.columns if rows.schema[c].dataType.typeName() not in ("map", "array", "binary")]
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*every), F.lit(salts)).cast("int"))
    repeated = few.withColumn("_part", F.explode(F.array(*map(F.lit, range(salts)))))
    return dealt.join(repeated, [*keys, "_part"], how).drop("_part")


def numbered(df: DataFrame, group: list[str], order: list[str], number: str) -> DataFrame:
    """`df` with the place of each row in its group, from 1. The rows are sorted by ranges over all tasks, not a group in one task: a row's number is its place in its
    range and the counts of the ranges before, of which a group has no more than there are tasks."""
    df = stage(df, "rows")  # finding the ranges reads the rows once more
    ranged = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    # written, for the ranges must be the same for both uses
    placed = stage(ranged.select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "ranges")
    counts = placed.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    names = [f"_g{i}" for i in range(len(group))]
    starts = counts.select(*(F.col(g).alias(n) for g, n in zip(group, names)), F.col("_range").alias("_in"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    on = F.col("_range") == F.col("_in")
    for g, n in zip(group, names):
        on = on & F.col(g).eqNullSafe(F.col(n))
    return placed.join(starts, on).select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before") + 1).cast("bigint").alias(number))
