"""Vector bin packing of documents into shards, balancing bytes, words and rows.

Equal texts form a group and stay together. Groups hash into at most
`bundles` units, so what the driver packs is bounded whatever the corpus; a
group too large for a shard's share is split by document id into several
units, of which there can be no more than `shards * split * 2`. The driver
places units, largest first, where the dot product of their vector with the
residual capacity is highest.

Defined results: a null text has 0 bytes (size 1) and the crc of no bytes;
null and empty texts form one group. Repeated rows are rows
like others. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import settle, text_or_empty, word_array


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tokens (words) and the group's hash `g` of each row."""
    t = text_or_empty()
    return docs.select(
        "doc_id",
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t).cast("long").alias("text_crc32"),
        F.size(word_array(t)).cast("long").alias("tokens"),
        F.xxhash64(t).alias("g"),
    )


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each vector: largest first, to the highest dot product with residual capacity."""
    total = vectors.sum(0).astype(float)
    v = vectors / np.where(total > 0, total, 1)
    residual = np.full((shards, v.shape[1]), 1.0 / shards)
    out = np.zeros(len(v), int)
    for i in np.argsort(-v.max(1), kind="stable"):
        # A shard without room in some dimension comes after those that have it in all.
        room = (residual >= v[i]).all(1)
        score = residual @ v[i]
        pick = np.flatnonzero(room) if room.any() else np.arange(shards)
        k = pick[np.argmax(score[pick])]
        out[i] = k
        residual[k] -= v[i]
    return out


def shard(docs: DataFrame, shards: int = 8, bundles: int = 1 << 15, split: int = 16) -> DataFrame:
    """Adds shard and slot to measured rows: equal texts together but for groups above 1 / split of a shard."""
    spark = docs.sparkSession
    rows = measure(docs)
    rows = settle(rows, "shard")
    sums = rows.groupBy("g").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("r"), F.sum("tokens").alias("t"))
    total = rows.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("r"), F.sum("tokens").alias("t")).first()
    if not total["r"]:
        return rows.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    share = max(1, shards * split)
    parts = F.greatest(*[F.ceil(F.col(k) * share / F.lit(max(1, total[k] or 0))) for k in "brt"])
    # Fewer than 3 * share groups can hold more than 1 / share of bytes, words or rows: a bounded table.
    large = sums.select("g", parts.cast("int").alias("parts")).where("parts > 1")
    dealt = rows.join(F.broadcast(large), "g", "left").select(
        *rows.columns,
        F.when(F.col("parts").isNotNull(), F.xxhash64("g", F.pmod(F.xxhash64("doc_id"), F.col("parts")))).otherwise(F.pmod(F.xxhash64("g"), F.lit(bundles))).alias("unit"),
    )
    units = dealt.groupBy("unit").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r")).orderBy("unit").collect()
    at = place(np.array([[u["b"], u["t"], u["r"]] for u in units], float), shards)
    begun, plan = [0] * shards, []
    for u, k in zip(units, at.tolist()):
        plan.append((u["unit"], k, begun[k]))
        begun[k] += u["r"]
    schema = T.StructType([T.StructField("unit", T.LongType()), T.StructField("shard", T.IntegerType()), T.StructField("begun", T.LongType())])
    plan_df = F.broadcast(spark.createDataFrame(plan, schema))
    order = Window.partitionBy("unit").orderBy("doc_id", "text_crc32", "size")
    return dealt.join(plan_df, "unit").select(*rows.columns, "shard", (F.col("begun") + F.row_number().over(order) - 1).alias("slot"))
