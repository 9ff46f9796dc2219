"""What the training-data operators share: the shared scratch folder, written intermediate tables, bounded slices of Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SLICE_BYTES = 4 << 20
#: Text of one group of documents; buckets of groups at most.
GROUP_BYTES, MOST_BUCKETS = 8 << 20, 1 << 16
#: A key with over one in HOT_SHARE of the rows is joined by broadcast; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset (tests, local mode) a temporary folder is made, set and removed at exit.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        local = tempfile.mkdtemp(prefix="factloom-")
        atexit.register(shutil.rmtree, local, True)
        root = "file://" + local
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/factloom/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    """Removes a table of this job by Hadoop's file system, so any store works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: For tables with wide rows: buffers that a writer fills before it writes them.
SMALL_BUFFERS = {"parquet.block.size": str(8 << 20), "parquet.page.size": str(128 << 10), "parquet.enable.dictionary": "false"}


#: Shuffle files go as soon as the job that made them ends, and not only when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within it, what is written leaves no shuffle files behind; nothing reads them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class _Passing(threading.local):
    """tables: those written within each `passing` that has begun, by thread."""

    def __init__(self) -> None:
        self.tables: list[list[DataFrame]] = []


_passing = _Passing()


@contextlib.contextmanager
def passing() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that are written within it go at its end (or at an error), but for those that the function it gives was called with."""
    tables: list[DataFrame] = []
    kept: set[str] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._factloom_path)
        return df

    _passing.tables.append(tables)
    try:
        yield keep
    finally:
        _passing.tables.pop()
        for df in tables:
            if df._factloom_path not in kept:
                drop_written(df)
            elif _passing.tables:
                _passing.tables[-1].append(df)


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cuts the lineage by a written table in the shared folder: later jobs reread it when executors are lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_removed(spark):
        df.write.options(**(options or {})).option("compression", "zstd").parquet(path)
    return _noted(spark.read.schema(df.schema).parquet(path), path)


def written_buckets(df: DataFrame, name: str, n: int, *keys: str) -> DataFrame:
    """The same as a table of n buckets, that later steps read by the keys without a shuffle."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = f"factloom_{name}_{path.rsplit('-', 1)[1]}"
    with shuffles_removed(spark):
        df.write.option("path", path).option("compression", "zstd").bucketBy(n, *keys).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._factloom_table = table
    return _noted(out, path)


def _noted(df: DataFrame, path: str) -> DataFrame:
    df._factloom_path = path
    if _passing.tables:
        _passing.tables[-1].append(df)
    return df


def drop_written(df: DataFrame) -> None:
    if table := getattr(df, "_factloom_table", None):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")
    if path := getattr(df, "_factloom_path", None):
        delete_path(df.sparkSession, path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, longer where the table has a column of the name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_or_empty(name: str = "text"):
    """Text of any type as string; null is the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds uid (partition and place in it) and g: a new group begins after every GROUP_BYTES of text."""
    first = TaskContext.get().partitionId() << 33
    place, size = 0, 0
    for batch in slices(batches, most=GROUP_BYTES):
        lens = np.asarray(pc.binary_length(column(batch, "text")), dtype=np.int64)
        before = size + np.cumsum(lens) - lens
        uid = first + place + np.arange(batch.num_rows)
        g = (first >> 9) + before // GROUP_BYTES
        place, size = place + batch.num_rows, size + int(lens.sum())
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "text"), pa.array(uid), pa.array(g)], names=["doc_id", "text", "uid", "g"])


def grouped_documents(docs: DataFrame, name: str) -> DataFrame:
    """Rows (doc_id, text as UTF-8 binary, uid, g) in a table bucketed by g, that later steps read group by group without a shuffle.

    A group is a run of rows of one input partition with GROUP_BYTES of text, or one row that is longer.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_or_empty(), "UTF-8").alias("text"))
    path = scratch_path(spark, "documents")
    table = f"factloom_{name}_{path.rsplit('-', 1)[1]}"
    n = min(MOST_BUCKETS, max(8, rows.rdd.getNumPartitions() * 2))
    grouped = rows.mapInArrow(_grouped, "doc_id long, text binary, uid long, g long")
    grouped.write.option("path", path).option("compression", "zstd").bucketBy(n, "g").format("parquet").saveAsTable(table)
    return spark.table(table)


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """rows joined with facts (one row for each key; `weight`: how many of rows have it, which is dropped).

    Keys with over one in HOT_SHARE of all rows, fewer than HOT_SHARE by that, are broadcast, so no task gets a hot key; the others are shuffled.
    """
    total = facts.agg(F.sum(weight)).first()[0] or 0
    hot = F.col(weight) * HOT_SHARE > F.lit(total)
    hot_facts = F.broadcast(facts.where(hot).drop(weight))
    rest = rows.join(F.broadcast(facts.where(hot).select(*keys)), keys, "left_anti")
    return rows.join(hot_facts, keys).unionByName(rest.join(facts.where(~hot).drop(weight), keys))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = MAX_SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that the column holds about `most` bytes in each slice (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(np.asarray(pc.binary_length(col).fill_null(0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))

