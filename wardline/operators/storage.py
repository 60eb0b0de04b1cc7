"""Cutting lineage: tables that later steps read more than once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written as Parquet into the shared folder and read again: not recomputed, and safe when executors are lost. A
    query's result may still read it, so it is left to whoever cleans that folder after the job."""
    path = shared_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str = "n") -> DataFrame:
    """df with a dense number from 1 within keys, by order. A large key is spread over ranges of its order: each range
    numbers its own rows, and the sizes of the ranges before it are added."""
    ranges = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = stored(df.repartitionByRange(int(ranges), *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    within = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)))
    sizes = dealt.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    earlier = sizes.select(*keys, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_earlier"))
    return within.join(earlier, [*keys, "_range"]).withColumn(name, F.col("_earlier") + F.col("_nth")).drop("_range", "_nth", "_earlier")


def latest_before(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """rows with value replaced by the last one that isn't null among the rows up to them in their key, by order. As in
    numbered(), a large key is spread over ranges of its order: each range looks among its own rows, and what the
    ranges before it end with is carried on."""
    ranges = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = stored(rows.repartitionByRange(int(ranges), *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ends = dealt.where(F.col(value).isNotNull()).groupBy(*keys, "_range").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    spans = dealt.select(*keys, "_range").distinct().join(ends, [*keys, "_range"], "left")
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(*keys, "_range", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    own = dealt.withColumn(value, F.last(value, ignorenulls=True).over(within))
    return own.join(carried, [*keys, "_range"]).withColumn(value, F.coalesce(value, "_carried")).drop("_range", "_carried")


def one_before(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """rows with name, what value was in the row before in their key, by order; null for a key's first. As in latest_before(), a
    large key is spread over ranges of its order, and what the range before ends with is carried on."""
    ranges = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    dealt = stored(rows.repartitionByRange(int(ranges), *keys, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    ends = dealt.groupBy(*keys, "_range").agg(F.max_by(value, F.struct(*order)).alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_range")))
    within = F.lag(value).over(Window.partitionBy(*keys, "_range").orderBy(*order))
    return dealt.join(ends, [*keys, "_range"]).withColumn(name, F.coalesce(within, "_end")).drop("_range", "_end")


def shared_path(spark, name: str) -> str:
    """A new place in the folder that driver and executors share, the session's spark.checkpoint.dir. Where it is unset, a
    session that runs in this process alone (as in tests) gets a new folder; on a cluster that is an error, since each
    executor would write to a disk of its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-wardline-")
    return f"{folder.rstrip('/')}/{name}"
