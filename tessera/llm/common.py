"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[^\x20\x09-\x0D]+"
"""A word: a run of characters other than space, tab, LF, VT, FF and CR."""

MAX_BATCH_ROWS = 1000
"""Rows handled at once; Spark bounds the bytes of what it sends (spark.sql.execution.arrow.maxBytesPerBatch)."""


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset it must be a local session, which gets a fresh one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, path, True)
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex[:12]}/{name}"


def store(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_in = path.rpartition("/")[0]
    return out


def discard(*tables: DataFrame) -> None:
    """Delete the files of stored tables, once everything made of them is stored itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._stored_in)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def tidy(batches):
    """Arrow batches cut to MAX_BATCH_ROWS rows; what Arrow has freed goes back to the system after each."""
    import pyarrow as pa

    for b in batches:
        for at in range(0, b.num_rows, MAX_BATCH_ROWS):
            yield b.slice(at, MAX_BATCH_ROWS)
        del b
        pa.default_memory_pool().release_unused()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def running_sum(df: DataFrame, order: list[Column], value: str, total: str) -> DataFrame:
    """Add the sum of the whole numbers `value` of each row and those before it, without one task seeing all.

    Rows are range-partitioned and summed per partition; only the partitions' sums meet in one task. Rows that agree in
    `order` come in any order.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = store(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    parts = dealt.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = parts.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return dealt.withColumn("_within", within).join(F.broadcast(before), "_part").withColumn(total, F.col("_before") + F.col("_within")).drop("_part", "_before", "_within")


def global_index(df: DataFrame, col: str, index: str) -> DataFrame:
    """Number the rows 0, 1, 2, ... by ascending `col` (code-point order, nulls last)."""
    return running_sum(df.withColumn("_one", F.lit(1).cast("long")), [F.col(col).asc_nulls_last()], "_one", index).withColumn(index, F.col(index) - 1).drop("_one")


def sample_bounds(ids: DataFrame, n: int, sample: int = 16) -> list[int]:
    """At most n - 1 ascending values of `id` that cut them into n nearly equal parts, the same however they are partitioned.

    They are quantiles of the ids with the smallest hashes; at most sample * n of those reach the driver.
    """
    if n < 2:
        return []
    rows = ids.filter("id is not null").distinct().orderBy(F.xxhash64("id"), "id").limit(sample * n).collect()
    found = sorted(r[0] for r in rows)
    return sorted({found[len(found) * i // n] for i in range(1, n)}) if found else []


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it several times inside `body` (a function of a column)."""
    return F.element_at(F.transform(F.array(value), body), 1)
