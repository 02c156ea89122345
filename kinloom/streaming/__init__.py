"""Entities as a stream against a static pool of records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.blocking import CAP, DEFAULT, MAX_BLOCK, candidates_against, capped, postings
from ..storage import exists


def link_stream(entities: DataFrame, pool_norm: DataFrame, path: str, checkpoint: str, strategies=DEFAULT, max_block: int = MAX_BLOCK, cap: int = CAP):
    """Starts a query that appends the candidate pairs of each micro-batch of normalised entities to `path`.

    The pool's capped postings are written beside the checkpoint once; every
    batch, and every restart, reads them. Each entity's candidates come from
    its own batch, so an entity that comes twice has its rows twice.
    """
    spark = pool_norm.sparkSession
    at = f"{checkpoint.rstrip('/')}-pool"
    if not exists(spark, f"{at}/_SUCCESS"):
        capped(postings(pool_norm, strategies), max_block).write.mode("overwrite").parquet(at)
    pool = spark.read.parquet(at)

    def batch(df: DataFrame, batch_id: int) -> None:
        # A batch that is run again replaces what it wrote before.
        candidates_against(df, pool, strategies, cap).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return entities.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
