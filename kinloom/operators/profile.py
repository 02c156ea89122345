"""Profiles of records, truth lists and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_country(raw: DataFrame) -> DataFrame:
    return raw.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("business_name") == "").alias("no_name"), F.count_if(F.col("business_address") == "").alias("no_address"), F.avg(F.length("business_name")).alias("mean_name_length"))


def list_sizes(lists: DataFrame) -> DataFrame:
    """How many entities have how many matches; singletons have none."""
    return lists.groupBy(F.size("matches").alias("size")).agg(F.count(F.lit(1)).alias("entities"))


def contention(truth: DataFrame) -> DataFrame:
    return truth.groupBy("pool_id").agg(F.count(F.lit(1)).alias("owners")).where("owners > 1")


def token_frequency(norm: DataFrame) -> DataFrame:
    """Records that hold each name token."""
    return norm.select(F.explode(F.array_distinct(F.filter(F.split("name_norm", " "), lambda t: t != ""))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("records"))


def length_quantiles(raw: DataFrame) -> DataFrame:
    q = lambda c, p: F.percentile(F.length(c), F.lit(p))
    return raw.agg(*[q(c, p).alias(f"{n}_p{str(p * 100).rstrip('0').rstrip('.').replace('.', '_')}") for c, n in (("business_name", "name"), ("business_address", "address")) for p in (0.5, 0.9, 0.99, 0.999)])


def duplicate_names(norm: DataFrame) -> DataFrame:
    """Records that share their name with another, by name."""
    return norm.where("name_norm != ''").groupBy("name_norm").agg(F.count(F.lit(1)).alias("records")).where("records > 1")
