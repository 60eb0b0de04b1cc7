"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of strings, and rows, that a Python function gets at a time.
SLICE_BYTES, SLICE_ROWS = 2 << 20, 500


_WORKER: dict = {}


def of_worker(key: tuple, make: Callable[[], object]) -> object:
    """What a worker process keeps from task to task, made when first asked for. Spark hands the same processes to one
    operator after the other, so they keep one thing at a time: the last one's is dropped."""
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = make()
    return _WORKER[key]


def release() -> None:
    """Hand back to the system what this worker has freed, at the end of a task: Spark keeps worker processes, and the C library
    would keep the memory for them beside the next operator's."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in consecutive parts of at most SLICE_ROWS rows and, but for single rows that are longer, SLICE_BYTES of
    strings, binaries and lists of numbers (8 bytes each). Every function over texts goes by them: what it makes of a part
    is gone before the next one, however many rows and bytes the session puts into a batch."""
    size = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        elif pa.types.is_list(column.type):
            size += 8 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right"))
        end = min(max(end, at + 1), at + SLICE_ROWS)
        yield batch.slice(at, end - at)
        at = end


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, the session's spark.checkpoint.dir. Where it is unset, a session that
    runs in this process alone (as in tests) gets a new folder; on a cluster that is an error, since each executor
    would write to a disk of its own."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-wardline-")


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: later steps neither recompute it nor
    depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Delete tables made by stored() that no later step reads."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def map_batches(df: DataFrame, fn: Callable[..., dict], schema: str) -> DataFrame:
    """mapInArrow with plain lists: fn gets one list for each column of df and returns a dict of columns in
    the order of schema."""
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = fn(*[c.to_pylist() for c in part.columns])
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in arrow], schema=arrow)
            pa.default_memory_pool().release_unused()
        release()

    return df.mapInArrow(run, schema)


def text_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, a null text as the empty one."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def keep_rows(docs: DataFrame, columns: list, decide: Callable[..., list]) -> DataFrame:
    """The rows of docs for which decide, given lists of the columns (a null text as ''), is true; no shuffle. Rows
    pass through whole, whatever their other columns."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = [part.column(names.index(c)) if c in names else pa.nulls(part.num_rows, pa.string()) for c in columns]
                lists = [(pc.fill_null(g, "") if c == "text" else g).to_pylist() for c, g in zip(columns, got)]
                yield part.filter(pa.array(decide(*lists), pa.bool_()))
            pa.default_memory_pool().release_unused()
        release()

    return docs.mapInArrow(run, docs.schema)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, add: Callable[[Column, Column], Column], zero: Column, chunk: int = 64) -> Column:
    """The running results of an associative add over an array: element i is that of the first i + 1 values. zero + x
    is x. An array that grew by one at a time would be copied whole at every step; here chunks of the array are summed
    first, so only their sums grow that way, and then each chunk goes on from the sum before it."""
    empty = F.slice(F.array(zero), 1, 0)

    def along(some: Column, start: Column) -> Column:
        step = lambda a, x: bound(add(a["at"], x), lambda at: F.struct(at.alias("at"), F.concat(a["out"], F.array(at)).alias("out")))
        return F.aggregate(some, F.struct(start.alias("at"), empty.alias("out")), step, lambda a: a["out"])

    def whole(all_: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / chunk).cast("int")), lambda k: F.slice(all_, k * chunk + 1, F.lit(chunk)))
        sums = lambda ps: along(F.transform(ps, lambda p: F.aggregate(p, zero, add)), zero)
        begins = lambda ps: F.concat(F.array(zero), sums(ps))
        each = lambda ps: F.flatten(F.transform(F.filter(F.arrays_zip(ps.alias("part"), begins(ps).alias("from")), lambda z: z["part"].isNotNull()), lambda z: along(z["part"], z["from"])))
        return F.when(F.size(all_) == 0, empty).otherwise(bound(parts, each))

    return bound(values, whole)
