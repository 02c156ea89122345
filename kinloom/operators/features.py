"""The 35 pair features: token arrays once a record, two joins, native values, then one Arrow pass for string measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..functions.text import non_empty
from ..session import ship
from ..skew import join_groups
from ..storage import freed_shuffles, fresh_path, settle

NAME = ["name_token_set_ratio", "name_token_sort_ratio", "name_token_jaccard", "name_partial_ratio", "name_edit_ratio", "name_jaro_winkler", "name_char_jaccard", "name_phonetic_match", "name_len_ratio", "name_token_count_delta", "name_first_token_match", "name_legal_match", "name_missing_left", "name_missing_right"]
ADDRESS = ["addr_token_jaccard", "addr_token_set_ratio", "addr_char_jaccard", "addr_house_match", "addr_house_similarity", "addr_postal_match", "addr_city_match", "addr_state_match", "addr_tail2_match", "addr_landmark_jaccard", "addr_len_ratio", "addr_missing_left", "addr_missing_right"]
CONTEXT = ["ctx_country_match", "ctx_country_known", "ctx_country_missing", "ctx_source_b", "ctx_candidate_degree", "ctx_source_frequency", "ctx_entity_candidate_count", "ctx_shared_block_keys"]
COLUMNS = NAME + ADDRESS + CONTEXT
HOT = 20_000
#: Parts of entities whose features settled() makes one after the other.
BLOCKS = 8


def with_context(pairs: DataFrame, norm: DataFrame) -> DataFrame:
    """Adds degree (pairs of the pool record), name frequency in the pool, and candidates of the entity."""
    of_record, own = counts(pairs, norm)
    # Merged, not broadcast: else few pairs would be sent to the one task that holds few counts, and all features made there.
    return pairs.join(of_record.hint("merge"), "pool_id").join(own.hint("merge"), "s1_id")


def counts(pairs: DataFrame, norm: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pool_id, degree, frequency) and (s1_id, candidates).

    Names of HOT records or more, of which there are few, are counted by broadcast.
    """
    pool = norm.where("source > 1").select(F.col("entity_id").alias("pool_id"), "name_norm")
    often = pool.groupBy("name_norm").agg(F.count(F.lit(1)).alias("frequency"))
    frequency = join_groups(pool, often, "name_norm", HOT, "frequency").select("pool_id", "frequency")
    degree = pairs.groupBy("pool_id").agg(F.count(F.lit(1)).alias("degree"))
    return degree.join(frequency, "pool_id"), pairs.groupBy("s1_id").agg(F.count(F.lit(1)).alias("candidates"))


def prepared(norm: DataFrame) -> DataFrame:
    """Token, gram and sound sets of each record, written before pairs multiply it: left lazy, Spark would make them a pair."""
    tokens = lambda c: non_empty(F.split(F.col(c), " "))
    long = lambda c: S.token_hashes(F.filter(tokens(c), lambda t: F.length(t) >= 2))
    sets = norm.select(
        "*",
        F.size(tokens("name_norm")).alias("nt"),
        F.get(tokens("name_norm"), 0).alias("n0"),
        long("name_norm").alias("ns"),
        S.char_grams(F.col("name_norm")).alias("ng"),
        S.token_hashes(S.soundexes(tokens("name_norm"))).alias("nx"),
        long("address_core").alias("as_"),
        S.char_grams(F.col("address_core")).alias("ag"),
        long("landmark_tokens").alias("ls"),
    )
    return settle(sets, "sets")


#: Features that Python measures: the fields of either record, and the measure.
STRINGS = {
    "name_token_set_ratio": ("name_norm", "token_set"), "name_token_sort_ratio": ("name_norm", "token_sort"), "name_partial_ratio": ("name_norm", "partial"), "name_edit_ratio": ("name_norm", "indel"),
    "name_jaro_winkler": ("name_norm", "jaro_winkler"), "addr_token_set_ratio": ("address_core", "token_set"), "addr_house_similarity": ("addr_house", "indel"),
}


def with_strings(rows: DataFrame, columns: list[str], heads: list[str]) -> DataFrame:
    """The first columns `heads` and `columns`, string measures filled in from the columns a_* and b_* in one Arrow pass.

    A null there means that either side lacks the field: its measures are 0.
    """
    asked = {f: sorted({m for c, (g, m) in STRINGS.items() if g == f and c in columns}) for f in ("name_norm", "address_core", "addr_house")}
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = {}
            for f, measures in asked.items():
                if not measures:
                    continue
                a, b = batch.column(names.index(f"a_{f}")), batch.column(names.index(f"b_{f}"))
                there = np.flatnonzero(np.asarray(a.is_valid()) & np.asarray(b.is_valid()))
                found = S.measure_columns(a.take(pa.array(there)).to_pylist(), b.take(pa.array(there)).to_pylist(), tuple(measures))
                for m, v in found.items():
                    value[f, m] = np.zeros(batch.num_rows)
                    value[f, m][there] = v
            made = [pa.array(value[STRINGS[c]]) if c in STRINGS else batch.column(names.index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(heads)], *made], [*heads, *columns])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in heads), *(f"{c} double" for c in columns)]))


def features(pairs: DataFrame, norm: DataFrame, known_countries: list[str], with_counts: bool = True, columns: list[str] | None = None) -> DataFrame:
    """s1_id, pool_id and the 35 features in their fixed order, or only `columns`.

    with_counts=False: `pairs` has the context counts already. Native values
    are made first, so that only numbers and strings go to Python, not sets.
    """
    return _measured(pairs, *sides(pairs, norm, with_counts), known_countries, columns)


def settled(pairs: DataFrame, norm: DataFrame, known_countries: list[str], keep: tuple[str, ...] = (), blocks: int = BLOCKS) -> DataFrame:
    """All 35 features of all pairs, after the columns `keep` of `pairs`, written block by block of entities.

    Records are sent to their pairs, which weighs far more than the features
    do: so only a block's share of that lies on the disks at a time. `pairs`
    and `norm` should be written tables.
    """
    spark, at = pairs.sparkSession, fresh_path(pairs.sparkSession, "features")
    left, right = (settle(x, "side") for x in sides(pairs, norm))
    block = F.pmod(F.xxhash64("s1_id"), F.lit(blocks))
    for k in range(blocks):
        some = _measured(pairs.where(block == k), left.where(block == k), right, known_countries, keep=keep)
        with freed_shuffles(spark):
            some.write.mode("overwrite").parquet(f"{at}/{k}")
    return spark.read.schema(some.schema).parquet(*[f"{at}/{k}" for k in range(blocks)])


def sides(pairs: DataFrame, norm: DataFrame, with_counts: bool = True) -> tuple[DataFrame, DataFrame]:
    """Records as entities and as pool, with a_ and b_ before their columns, and with their counts over `pairs`."""
    one = prepared(norm)
    side = lambda test, own, mark: one.where(test).select(F.col("entity_id").alias(own), *[F.col(c).alias(mark + c) for c in one.columns if c not in ("entity_id", "head")])
    left, right = side("source = 1", "s1_id", "a_"), side("source > 1", "pool_id", "b_")
    if with_counts:
        of_record, own = counts(pairs, norm)
        left, right = left.join(own, "s1_id"), right.join(of_record, "pool_id")
    return left, right


def _measured(pairs: DataFrame, left: DataFrame, right: DataFrame, known_countries: list[str], columns: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    heads, columns = ["s1_id", "pool_id", *keep], list(COLUMNS if columns is None else columns)
    # Features cost far more than their rows weigh: they are dealt over all cores, however few bytes they are.
    spark = pairs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    p = pairs.repartition(tasks, "s1_id").join(left.hint("merge"), "s1_id").join(right.hint("merge"), "pool_id")
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    has_name = (a("name_norm") != "") & (b("name_norm") != "")
    has_addr = (a("address_core") != "") & (b("address_core") != "")
    has_house = has_addr & (a("addr_house") != "") & (b("addr_house") != "")
    num = lambda c: c.cast("double")
    country = (a("country_norm") != "") & (b("country_norm") != "")
    value = {
        "name_token_jaccard": S.jaccard(a("ns"), b("ns")), "name_char_jaccard": S.jaccard(a("ng"), b("ng")), "name_phonetic_match": S.jaccard(a("nx"), b("nx")),
        "name_len_ratio": S.length_ratio(a("name_norm"), b("name_norm")), "name_token_count_delta": num(F.abs(a("nt") - b("nt"))), "name_first_token_match": num(a("n0") == b("n0")),
        "name_legal_match": S.same(a("name_legal"), b("name_legal")),
        "addr_token_jaccard": S.jaccard(a("as_"), b("as_")), "addr_char_jaccard": S.jaccard(a("ag"), b("ag")), "addr_house_match": S.same(a("addr_house"), b("addr_house")),
        "addr_postal_match": S.same(a("addr_postal"), b("addr_postal")),
        "addr_city_match": S.same(a("addr_city"), b("addr_city")), "addr_state_match": S.same(a("addr_state"), b("addr_state")), "addr_tail2_match": S.same(a("addr_tail2"), b("addr_tail2")),
        "addr_landmark_jaccard": S.jaccard(a("ls"), b("ls")), "addr_len_ratio": S.length_ratio(a("address_core"), b("address_core")),
        "ctx_country_match": S.same(a("country_norm"), b("country_norm")), "ctx_country_known": num(a("country_norm").isin(*known_countries) & b("country_norm").isin(*known_countries)) if known_countries else F.lit(0.0),
        "ctx_country_missing": num(~country), "ctx_source_b": num(b("source")), "ctx_candidate_degree": F.log1p(num(F.col("degree"))), "ctx_source_frequency": F.log1p(num(F.col("frequency"))),
        "ctx_entity_candidate_count": F.log1p(num(F.col("candidates"))), "ctx_shared_block_keys": num(F.col("evidence")),
    }
    for side, c in (("left", a), ("right", b)):
        value[f"name_missing_{side}"], value[f"addr_missing_{side}"] = num(c("name_norm") == ""), num(c("address_core") == "")
    cols = []
    for f in columns:
        if f in STRINGS:
            continue
        v = value[f]
        if f in NAME and "missing" not in f:
            v = F.when(has_name, v).otherwise(0.0)
        if f in ADDRESS and "missing" not in f:
            v = F.when(has_addr, v).otherwise(0.0)
        cols.append(F.coalesce(v, F.lit(0.0)).alias(f))
    fields = dict.fromkeys(STRINGS[f][0] for f in columns if f in STRINGS)
    if not fields:
        return p.select(*heads, *cols)
    fine = {"name_norm": has_name, "address_core": has_addr, "addr_house": has_house}
    texts = [F.when(fine[f], side(f)).alias(f"{n}_{f}") for f in fields for n, side in (("a", a), ("b", b))]
    return with_strings(p.select(*heads, *cols, *texts), columns, heads)
