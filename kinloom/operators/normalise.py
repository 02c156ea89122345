"""Raw records to normalised ones, in one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.address import parse_address
from ..functions.text import clean_missing, normalise_country, with_name


def normalise(raw: DataFrame, scripts: bool = True) -> DataFrame:
    """entity_id, source and the normalised name, legal form, address parts, country and presence flags."""
    one = raw.select(
        "entity_id",
        F.col("source").cast("byte").alias("source"),
        clean_missing(F.col("business_name")).alias("__name"),
        clean_missing(F.col("business_address")).alias("__addr"),
        normalise_country(clean_missing(F.col("country"))).alias("country_norm"),
    )
    two = parse_address(with_name(one, "__name", "__n", scripts), "__addr", "country_norm", "__a", scripts)
    return two.select(
        "entity_id",
        "source",
        "country_norm",
        F.col("__n.core").alias("name_norm"),
        F.col("__n.legal").alias("name_legal"),
        F.col("__a.core").alias("address_core"),
        F.col("__a.norm").alias("address_norm"),
        F.col("__a.house").alias("addr_house"),
        F.col("__a.postal").alias("addr_postal"),
        F.col("__a.state").alias("addr_state"),
        F.col("__a.city").alias("addr_city"),
        F.col("__a.tail2").alias("addr_tail2"),
        F.col("__a.landmark").alias("landmark_tokens"),
        (F.col("__n.core") != "").alias("name_present"),
        (F.col("__a.core") != "").alias("address_present"),
    )
