"""Committed intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import uuid

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

_applications: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """This application's folder in what all executors share: the folder that the cluster names in spark.checkpoint.dir, or
    the warehouse where none is named. The folder goes when the program ends."""
    app = spark.sparkContext.applicationId
    shared = (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
    root = f"{shared}/graphloom/{app}"
    if _applications.get(app) != root:
        _applications[app] = root
        atexit.register(_clear, root)
    return root


def _clear(root: str) -> None:
    try:  # the JVM may have gone before
        jvm = SparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(root)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except Exception:
        pass


def committed(df: DataFrame, name: str, compression: str = "zstd", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", compression)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back = back.select(*df.columns) if partition_by else back
    back._graphloom_path = path
    return back


def committed_parts(parts: list[tuple[str, DataFrame]], name: str, column: str) -> DataFrame:
    """One committed table of parts (value of `column`, rows without that column), each written into its value's folder as it
    comes: nothing is shuffled or sorted by the column. Parts of one value add up."""
    spark = parts[0][1].sparkSession
    path = f"{work_root(spark)}/{name}-{uuid.uuid4().hex}"
    for value, rows in parts:
        rows.write.mode("append").option("compression", "zstd").parquet(f"{path}/{column}={value}")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in parts[0][1].schema), T.StructField(column, T.StringType())])
    back = spark.read.schema(schema).parquet(path)
    back._graphloom_path = path
    return back


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with their place (`number`, from 0) in an order: the place within a range and what the ranges before hold, so that no
    task sees all rows."""
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    ordered = committed(ordered, name)
    starts = ordered.groupBy("part").agg(F.count("*").alias("count"), F.min("at").alias("first")).withColumn("before", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ordered.join(F.broadcast(starts), "part").withColumn("number", F.col("at") - F.col("first") + F.col("before")).select(*rows.columns, "number")


#: Words of 64 bits that a table of likely keys may have: one bit for each hash.
WORDS = 1 << 20


def likely(rows: DataFrame, columns: list[str], keys: DataFrame) -> DataFrame:
    """rows with one column more, `__likely`: whether any of the columns may hold a key (column id): always where one does, else rarely.
    It lets rows that cannot match stay out of the shuffle of an exact join, which has to follow. Whatever the number of keys, the bits take at most
    16 MB."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(WORDS * 64))
    words = keys.select(bit("id").alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits"))
    words = committed(words, "likely-keys")
    out = rows.withColumn("__likely", F.lit(False))
    for c in columns:
        w = F.broadcast(words.select(F.col("w").alias("__w"), F.col("bits").alias("__bits")))
        hit = F.coalesce(F.expr("shiftright(__bits, cast(pmod(xxhash64(`%s`), %d) & 63 as int)) & 1 = 1" % (c, WORDS * 64)), F.lit(False))
        out = out.join(w, F.shiftright(bit(c), 6) == F.col("__w"), "left").withColumn("__likely", F.col("__likely") | hit).drop("__w", "__bits")
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by committed() that nothing reads any more."""
    path = getattr(df, "_graphloom_path", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver notice unreachable shuffles now, so that executors delete their files."""
    gc.collect()
    spark._jvm.System.gc()
