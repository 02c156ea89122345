"""Small helpers that every operator of this subpackage uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.session import ship
from kinloom.skew import hot_size, join_groups
from kinloom.storage import drop_table, fresh_path, settle, shared_dir

__all__ = ["bounded_batches", "drop_table", "fresh_path", "hot_size", "join_groups", "settle", "shared_dir", "table", "text_or_empty", "word_array"]

#: ASCII white space that separates words: space, tab, LF, VT, FF, CR.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RE = "[\\x20\\x09-\\x0D]+"
WORD_RE = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Lower-cases A-Z only, in UTF-8 bytes.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
LOWER_TEXT = str.maketrans(UPPER, LOWER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Arrow batches end at this many rows or bytes, as one text can be very long.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Before Python runs: ships the package, and bounds Arrow batches where the session allows larger ones.

    Spark reads both settings when a plan runs, so they stay set; a session's own lower bounds are kept.
    """
    ship(spark)
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name).rstrip("bB")
        if not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def word_array(text):
    """Words of a text column, split at ASCII white space; an empty array where there are none."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))
