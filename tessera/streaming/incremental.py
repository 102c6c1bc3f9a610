"""Sources that arrive bit by bit: each micro-batch is matched against all targets, with the same plan as a whole run.

A source's candidates don't depend on other sources, so the union of the batches' results is the whole run's result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import blocks
from tessera.operators.keys import prepare
from tessera.sources.scratch import new_folder


def match_stream(arriving: DataFrame, targets: DataFrame, out: str, checkpoint: str, k: int = 25, strategy: str = "8", once: bool = True):
    """Start a query that appends the top-K lists of arriving sources (a streaming frame of records) to Parquet in `out`.

    A batch that is repeated after a failure replaces its own folder, so each batch counts once.
    """
    t = prepare(targets)

    def match(batch: DataFrame, number: int) -> None:
        s = prepare(batch)
        blocks.top_k(s, t, strategy, k).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = arriving.writeStream.foreachBatch(match).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def match_batches(sources: DataFrame, targets: DataFrame, batches: int, k: int = 25) -> DataFrame:
    """The top-K lists of sources that are fed to match_stream() in so many batches."""
    spark = sources.sparkSession
    base = new_folder(spark, "stream")
    # One write deals the sources out; each file is a batch, at least `batches` of them if there are so many sources.
    sources.repartition(batches, F.xxhash64("entity_id")).write.parquet(f"{base}/in")
    arriving = spark.readStream.schema(sources.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    match_stream(arriving, targets, f"{base}/out", f"{base}/state", k).awaitTermination()
    return spark.read.parquet(f"{base}/out").drop("batch")
