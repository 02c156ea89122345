"""Blocking: keys, block caps, candidate pairs with evidence, top k an entity.

Each record gives keys of several strategies; a key's block joins records of
the entity side to those of the pool. Blocks above the cap are dropped before
the join, by a count on the pool side that is partially summed; only their
keys, few and broadcast, meet the postings. The entity side has no cap: its hot
keys are dealt over salts, and their blocks, which the cap bounds, go to each.
Evidence counts matching postings; order is by evidence, then id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import in_list, non_empty
from ..functions import vocab as V

LONGEST_KEY = 63
MAX_BLOCK, CAP = 500, 200
#: Entity postings of one key that go to one task.
SALT_ROWS = 20_000
#: Above so many postings, an oversize block is left out by broadcast of its key.
HOT = 20_000


def _tokens(name: str) -> Column:
    return non_empty(F.split(F.col(name), " "))


def content_tokens() -> Column:
    """The first four name tokens of three characters or more that are no stop words."""
    return F.slice(F.filter(_tokens("name_norm"), lambda t: (F.length(t) >= 3) & ~in_list(t, V.NAME_STOPWORDS)), 1, 4)


def address_tokens() -> Column:
    """The three longest core tokens of four characters or more, longest first, earlier ones first among equals."""
    kept = F.filter(_tokens("address_core"), lambda t: (F.length(t) >= 4) & ~t.rlike("^[0-9]+$"))
    order = F.array_sort(F.transform(kept, lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("i"), t.alias("t"))))
    return F.slice(F.transform(order, lambda x: x["t"]), 1, 3)


def _one(test: Column, key: Column) -> Column:
    return F.when(test, F.array(key)).otherwise(F.array().cast("array<string>"))


def _longest(tokens: Column) -> Column:
    order = F.array_sort(F.transform(tokens, lambda t, i: F.struct((-F.length(t)).alias("l"), i.alias("i"), t.alias("t"))))
    return F.coalesce(F.get(order, 0)["t"], F.lit(""))


#: Strategy: key prefix and keys of a record.
STRATEGIES = {
    "name_token": ("nt", lambda: content_tokens()),
    "name_sorted": ("ns", lambda: _one(F.size(content_tokens()).between(2, 4), F.array_join(F.array_sort(content_tokens()), "|"))),
    "name_phonetic": ("sx", lambda: F.transform(F.filter(content_tokens(), lambda t: (F.length(t) >= 4) & t.rlike("^[a-z]")), F.soundex)),
    "addr_postal": ("pc", lambda: _one(F.col("addr_postal") != "", F.col("addr_postal"))),
    "addr_token": ("at", lambda: address_tokens()),
    "addr_house": ("hs", lambda: _one((F.col("addr_house") != "") & (F.size(address_tokens()) > 0), F.concat_ws("|", "addr_house", F.get(address_tokens(), 0)))),
    "addr_tail": ("tl", lambda: _one(F.col("addr_tail2") != "", F.col("addr_tail2"))),
    "country_name": ("cn", lambda: _one((F.col("country_norm") != "") & (F.size(content_tokens()) > 0), F.concat_ws("|", "country_norm", _longest(content_tokens())))),
}
DEFAULT = tuple(s for s in STRATEGIES if s != "name_phonetic")


def postings(norm: DataFrame, strategies=DEFAULT) -> DataFrame:
    """(strategy, key, entity_id), with repeats kept; keys that are too long are dropped, not cut."""
    unknown = set(strategies) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies: {sorted(unknown)}")

    def keyed(s: str) -> Column:
        prefix, keys = STRATEGIES[s]
        return F.transform(keys(), lambda k: F.struct(F.lit(s).alias("strategy"), F.concat_ws("|", F.lit(prefix), k).alias("key")))

    keys = F.concat(*map(keyed, strategies))
    some = norm.where("name_norm != '' or address_core != ''")
    return some.select("entity_id", F.explode(keys).alias("k")).select("k.strategy", "k.key", "entity_id").where(F.length("key") <= LONGEST_KEY)


def block_sizes(posted: DataFrame) -> DataFrame:
    return posted.groupBy("strategy", "key").agg(F.count(F.lit(1)).alias("n"))


def capped(posted: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """Postings whose block holds at most `max_block` of them.

    Blocks far above the cap are left out by broadcast: at most one in HOT postings begins one. The others are shuffled.
    """
    sizes = block_sizes(posted)
    hot = sizes.where(F.col("n") > max(max_block, HOT)).select("strategy", "key")
    rest = posted.join(F.broadcast(hot), ["strategy", "key"], "left_anti")
    return rest.join(sizes.where(F.col("n").between(max_block + 1, max(max_block, HOT))).select("strategy", "key"), ["strategy", "key"], "left_anti")


def reblock(posted: DataFrame, applied: int, max_block: int) -> DataFrame:
    """Postings that were capped at `applied`, capped lower. A wider cap cannot bring dropped blocks back: it raises."""
    if max_block > applied:
        raise ValueError(f"a cap of {applied} was applied: {max_block} would need the raw postings")
    return capped(posted, max_block)


def evidence(s1: DataFrame, pool: DataFrame, max_block: int = MAX_BLOCK, distinct: bool = False) -> DataFrame:
    """(s1_id, pool_id, evidence) of all pairs that share a block; `distinct` counts strategies instead of postings."""
    n = F.count_distinct("strategy") if distinct else F.count(F.lit(1))
    return joined(s1, capped(pool, max_block)).groupBy("s1_id", "pool_id").agg(n.cast("int").alias("evidence"))


def joined(s1: DataFrame, pool: DataFrame, salt_rows: int = SALT_ROWS) -> DataFrame:
    """(strategy, s1_id, pool_id) of postings that share a key; keys with many entities are dealt over salts."""
    keys = ["strategy", "key"]
    # At most one in `salt_rows` entity postings begins such a key: they are broadcast.
    hot = F.broadcast(block_sizes(s1).where(F.col("n") > salt_rows).select(*keys, F.ceil(F.col("n") / salt_rows).cast("int").alias("salts")))
    left = s1.withColumnRenamed("entity_id", "s1_id").join(hot, keys, "left").select(*keys, "s1_id", F.pmod(F.xxhash64("s1_id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"))
    right = pool.withColumnRenamed("entity_id", "pool_id").join(hot, keys, "left").select(*keys, "pool_id", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt"))
    return left.join(right, [*keys, "salt"]).select("strategy", "s1_id", "pool_id")


def query_volume(s1: DataFrame, pool: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """How many postings the join would give, by strategy, without making it."""
    a, b = block_sizes(s1).withColumnRenamed("n", "a"), block_sizes(pool).where(F.col("n") <= max_block)
    return a.join(b, ["strategy", "key"]).groupBy("strategy").agg(F.sum(F.col("a") * F.col("n")).alias("pairs"))


def top_candidates(pairs: DataFrame, cap: int = CAP) -> DataFrame:
    """The `cap` pairs of each entity with most evidence; ties by pool id. Evidence is cut at 255."""
    order = Window.partitionBy("s1_id").orderBy(F.desc("evidence"), "pool_id")
    return pairs.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= cap).select("s1_id", "pool_id", F.least("evidence", F.lit(255)).alias("evidence"))


def candidates_against(entities: DataFrame, pool: DataFrame, strategies=DEFAULT, cap: int = CAP) -> DataFrame:
    """Candidates of normalised entities against postings of the pool that are capped already."""
    n = F.count(F.lit(1)).cast("int").alias("evidence")
    return top_candidates(joined(postings(entities, strategies), pool).groupBy("s1_id", "pool_id").agg(n), cap)


def candidates(norm: DataFrame, strategies=DEFAULT, max_block: int = MAX_BLOCK, cap: int = CAP) -> DataFrame:
    """Candidate pairs between source 1 and the pool of the other sources."""
    side = lambda test: postings(norm.where(test), strategies)
    return top_candidates(evidence(side("source = 1"), side("source > 1"), max_block), cap)


def capped_lists(lists: DataFrame, cap: int = CAP, column: str = "pool_ids") -> DataFrame:
    """The first `cap` distinct ids of each given list, in their order; null lists are empty."""
    ids = F.coalesce(column, F.array().cast("array<string>"))
    return lists.withColumn(column, F.slice(F.array_distinct(ids), 1, cap))


def blocking_statistics(entities: DataFrame, pairs: DataFrame, pool_size: int, cap: int = CAP, before_cap: DataFrame | None = None) -> DataFrame:
    """One row: entities, those without candidates and their share, pairs, mean, most, entities at the cap, reduction ratio.

    `before_cap` are the pairs that the cap chose from; with them, pairs_before_cap is counted.
    """
    n = entities.select("s1_id").join(pairs.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")), "s1_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    out = n.agg(
        F.count(F.lit(1)).alias("entities"),
        F.count_if(F.col("n") == 0).alias("entities_without_candidates"),
        F.avg((F.col("n") == 0).cast("double")).alias("share_without_candidates"),
        F.sum("n").alias("pairs_kept"),
        F.avg("n").alias("mean_candidates"),
        F.max("n").alias("max_candidates"),
        F.count_if(F.col("n") >= cap).alias("cap_fired_entities"),
    )
    out = out.withColumn("reduction_ratio", 1 - F.col("pairs_kept") / (F.col("entities") * F.lit(max(1, pool_size))))
    if before_cap is None:
        return out
    return out.crossJoin(before_cap.agg(F.count(F.lit(1)).alias("pairs_before_cap")))  # one row by one row


def recall_sweep(norm: DataFrame, truth: DataFrame, entities: DataFrame, caps=(50, 100, 200, 400, 800), max_blocks=(MAX_BLOCK,), strategies=DEFAULT) -> DataFrame:
    """max_block, cap, pair_recall, entity_full_recall, mean_candidates.

    Evidence is made once a max_block and ranked once for the largest cap: all
    caps read that. The loop is over the given parameters.
    """
    from .matching import proposed

    side = lambda test: postings(norm.where(test), strategies)
    s1, pool, out = side("source = 1"), side("source > 1"), None
    caps = sorted(set(caps))
    for max_block in max_blocks:
        order = Window.partitionBy("s1_id").orderBy(F.desc("evidence"), "pool_id")
        ranked = evidence(s1, pool, max_block).withColumn("r", F.row_number().over(order)).where(F.col("r") <= caps[-1])
        hits = truth.select("s1_id", "pool_id").join(ranked, ["s1_id", "pool_id"], "left").select("s1_id", "r")
        per = hits.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("r") <= c).alias(f"h{c}") for c in caps])
        found = per.agg(*[F.struct((F.sum(f"h{c}") / F.sum("n")).alias("pair"), F.avg((F.col(f"h{c}") == F.col("n")).cast("double")).alias("full")).alias(f"c{c}") for c in caps])
        held = entities.select("s1_id").join(ranked.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n")), "s1_id", "left").agg(*[F.avg(F.least(F.coalesce("n", F.lit(0)), F.lit(c))).alias(f"m{c}") for c in caps])
        one = found.crossJoin(held)  # one row by one row
        rows = F.explode(F.array(*[F.struct(F.lit(c).alias("cap"), F.col(f"c{c}.pair").alias("pair_recall"), F.col(f"c{c}.full").alias("entity_full_recall"), F.col(f"m{c}").alias("mean_candidates")) for c in caps]))
        one = one.select(F.lit(max_block).alias("max_block"), rows.alias("x")).select("max_block", "x.*")
        out = one if out is None else out.unionByName(one)
    return out


def leave_one_out(norm: DataFrame, truth: DataFrame, strategies=DEFAULT, max_block: int = MAX_BLOCK, cap: int = CAP) -> DataFrame:
    """left_out, pair_recall, entity_full_recall: recall with each strategy left out, and with all (left_out is empty)."""
    from .matching import recall

    side = lambda test: postings(norm.where(test), strategies)
    s1, pool, out = side("source = 1"), side("source > 1"), None
    for left_out in ("", *strategies):
        keep = lambda p: p.where(F.col("strategy") != left_out)  # noqa: B023, E731
        one = recall(truth, top_candidates(evidence(keep(s1), keep(pool), max_block), cap)).select(F.lit(left_out).alias("left_out"), "pair_recall", "entity_full_recall")
        out = one if out is None else out.unionByName(one)
    return out
