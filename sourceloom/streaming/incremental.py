"""Incremental knowledge base: new file versions in, the newest version per path kept.

Each micro-batch is analysed by the same map-only plan as a full build and written to a
folder of its own, named by batch id. A replayed batch overwrites its folder with the
same rows. Readers take the newest version per path; ``merge`` folds the batches into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sourceloom.operators import kb as K
from sourceloom.sources.corpus import spread


def start(versions: DataFrame, patterns: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """``versions`` is a stream of source files; a higher ``version``, or ``file_id`` where there is none, is newer."""
    def write(batch: DataFrame, batch_id: int) -> None:
        built = K.build(K.candidates(spread(batch), patterns))  # a batch of few files keeps all cores busy
        built.write.mode("overwrite").parquet(f"{table}/batch_id={batch_id}")

    return (
        versions.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def newest(spark: SparkSession, table: str) -> DataFrame:
    """The current rows: newest version per repository and path.

    The winner per path is found on narrow columns with partial aggregation; the
    wide rows are then picked by its key, which no hot path can crowd.
    """
    rows = spark.read.parquet(table)
    key = [c for c in ("version", "file_id", "batch_id") if c in rows.columns]
    winners = rows.groupBy("repo", "path").agg(F.max(F.struct(*key)).alias("w"))
    return rows.join(winners.select(*[F.col(f"w.{c}").alias(c) for c in key]), key, "left_semi")


def merge(spark: SparkSession, table: str, target: str) -> None:
    """Write the current rows as a fresh table with one batch."""
    newest(spark, table).drop("batch_id").write.mode("overwrite").parquet(f"{target}/batch_id=0")
