"""Sources and sinks: tab-separated records, truth and match lists, Parquet caches, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists, is_folder, write_json

RAW = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"
TSV = {"sep": "\t", "header": True, "encoding": "UTF-8", "quote": '"', "escape": '"', "enforceSchema": True}


def dataset_folder(spark: SparkSession, candidates: list[str]) -> str:
    """The first folder, of any file system that Spark reads, that holds train/ and test/."""
    for c in candidates:
        if all(is_folder(spark, f"{c}/{s}") for s in ("train", "test")):
            return c
    raise FileNotFoundError(f"none of {candidates} holds train/ and test/")


def source_path(folder: str, split: str, source: int) -> str:
    return f"{folder}/{split}/{split}_source{source}.tsv"


def truth_path(folder: str, split: str, override: str | None = None) -> str:
    """Where the truth is; `override` names another file, as for a sliced run."""
    return override or f"{folder}/{split}/{split}_ground_truth.tsv"


def source_of(entity_id):
    """1, 2 or 3 by the id's prefix, else 0."""
    return F.when(entity_id.startswith("S1-"), 1).when(entity_id.startswith("S2-"), 2).when(entity_id.startswith("S3-"), 3).otherwise(0).cast("byte")


def read_source(spark: SparkSession, path: str, source: int | None = None, limit: int | None = None) -> DataFrame:
    """One source; missing values are empty strings. `limit` takes the least ids, so that it is repeatable."""
    df = spark.read.options(**TSV).schema(RAW).csv(path).na.fill("")
    df = df.withColumn("source", F.lit(source).cast("byte") if source else source_of(F.col("entity_id")))
    return df.orderBy("entity_id").limit(limit) if limit else df


def read_sources(spark: SparkSession, folder: str, split: str, sources=(1, 2, 3)) -> DataFrame:
    out = None
    for s in sources:
        one = read_source(spark, source_path(folder, split, s), s)
        out = one if out is None else out.unionByName(one)
    return out


def wrong_prefixes(df: DataFrame, most: int = 5) -> DataFrame:
    """The first rows whose id contradicts their source."""
    return df.where(source_of(F.col("entity_id")) != F.col("source")).orderBy("entity_id").limit(most)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """s1_id and the array of its matches; empty for a singleton."""
    raw = spark.read.options(**TSV).schema(TRUTH).csv(path).na.fill("")
    return raw.select(F.col("source1_entity_id").alias("s1_id"), F.filter(F.split("matched_entity_ids", ","), lambda x: F.trim(x) != "").alias("matches"))


def truth_pairs(truth: DataFrame) -> DataFrame:
    return truth.select("s1_id", F.explode("matches").alias("pool_id")).distinct()


def _mark(df: DataFrame):
    """Rows and a sum of their hashes: tables of the same rows in any order have the same."""
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)"))).first())


def write_cache(df: DataFrame, path: str) -> int:
    """Normalised records as zstd Parquet by source, in one pass; the rows counted on the way are those in the footers after it."""
    from pyspark.sql import Observation

    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", "zstd").partitionBy("source").parquet(path)
    wrote, there = seen.get["rows"], df.sparkSession.read.parquet(path).count()
    if wrote != there:
        raise RuntimeError(f"{path} holds {there} of {wrote} rows")
    return there


def cached(df: DataFrame, path: str) -> DataFrame:
    """The cache at `path`, made anew unless it holds just the rows of `df`: their number and their hashes count."""
    spark = df.sparkSession
    typed = lambda x: x.select(*[F.col(f.name).cast(f.dataType) for f in df.schema.fields])
    if exists(spark, f"{path}/_SUCCESS"):
        old = spark.read.parquet(path)
        if set(old.columns) == set(df.columns) and _mark(typed(old)) == _mark(df):
            return old
    write_cache(df, path)
    return spark.read.parquet(path)


def read_cache(spark: SparkSession, path: str, sources=(1, 2, 3), columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if columns and (bad := set(columns) - set(df.columns)):
        raise ValueError(f"unknown columns: {sorted(bad)}")
    df = df.where(F.col("source").isin(*sources))
    return df.select(*dict.fromkeys(["entity_id", *columns])) if columns else df


def id_lists(entities: DataFrame, pairs: DataFrame, name: str = "matched_entity_ids") -> DataFrame:
    """One row an entity of S1, with its pool ids distinct, sorted and comma-joined; empty if it has none."""
    lists = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("pool_id")), ",").alias(name))
    return entities.select("s1_id").join(lists, "s1_id", "left").select(F.col("s1_id").alias("source1_entity_id"), F.coalesce(name, F.lit("")).alias(name))


def write_lists(lists: DataFrame, path: str, one_file: bool = False) -> None:
    """Tab-separated with a header; `one_file` gathers the rows in one part, for lists that one disk holds."""
    out = lists.coalesce(1) if one_file else lists
    out.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def read_lists(spark: SparkSession, path: str) -> DataFrame:
    """A written file of lists with the header it has; missing values are empty strings."""
    return spark.read.options(sep="\t", header=True, encoding="UTF-8").csv(path).na.fill("")


def write_report(spark: SparkSession, report: dict, path: str) -> None:
    write_json(spark, report, path)


def claims_in_blocks(spark: SparkSession, pairs: DataFrame, score, path: str, blocks: int, key: str) -> DataFrame:
    """Claims of all pairs, made block by block of entities; blocks that were finished under the same key are not made again.

    `score` gives the claims of a frame of pairs. `key` names the model and the
    threshold: a run with another one begins anew. A block's folder counts as
    finished by the mark of its commit.
    """
    part = F.pmod(F.xxhash64("s1_id"), F.lit(blocks))
    folders = [f"{path}/{key}/blocks={blocks}/block={k}" for k in range(blocks)]
    for k, folder in enumerate(folders):
        if not exists(spark, f"{folder}/_SUCCESS"):
            score(pairs.where(part == k)).write.mode("overwrite").parquet(folder)
    return spark.read.parquet(*folders)
