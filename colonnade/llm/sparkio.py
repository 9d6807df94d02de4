"""Shared folders and numbering that no single task has to do."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, set here only where it is unset."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isDefined():
            return known.get()
        import tempfile

        at = "file://" + tempfile.mkdtemp(prefix="colonnade-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(at)
    return at


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Removes what stored() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, part_rows: int = 200_000) -> DataFrame:
    """Adds out: a gapless number from 0 within each group.

    A group is dealt to parts of about ``part_rows`` rows by a hash of its order
    columns, its rows are numbered within each part, and moved on by the sizes of
    the parts before. So a group that holds a third of all rows is numbered by
    many tasks. Groups have to be bounded in number: what is broadcast is one row
    for each group, and one for each part_rows rows besides.
    """
    size = df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / part_rows).alias("__cuts"))
    marked = df.join(F.broadcast(size), group).withColumn("__part", F.pmod(F.xxhash64(*order), F.col("__cuts"))).drop("__cuts")
    inside = marked.withColumn("__n", F.row_number().over(W.partitionBy(*group, "__part").orderBy(*order)).cast("long") - 1)
    count = marked.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__c"))
    before = count.select(*group, "__part", (F.sum("__c").over(W.partitionBy(*group).orderBy("__part")) - F.col("__c")).alias("__b"))
    return inside.join(F.broadcast(before), [*group, "__part"]).withColumn(out, F.col("__n") + F.col("__b")).drop("__part", "__n", "__b")


def unsigned_crc32(text: Column) -> Column:
    """crc32 of a string's UTF-8 bytes; Spark's crc32 is unsigned already."""
    return F.crc32(F.encode(text, "UTF-8"))
