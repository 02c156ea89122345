"""Labels, splits, samples, scores, one owner a record, threshold sweep and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Labels and recall


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds `label`: 1 for pairs in truth (s1_id, pool_id)."""
    return pairs.join(truth.select("s1_id", "pool_id", F.lit(1).alias("__t")), ["s1_id", "pool_id"], "left").select(*pairs.columns, F.coalesce("__t", F.lit(0)).alias("label"))


def proposed(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds `hit` to each truth pair: whether it is a candidate."""
    return truth.join(pairs.select("s1_id", "pool_id", F.lit(True).alias("__p")), ["s1_id", "pool_id"], "left").select(*truth.columns, F.coalesce("__p", F.lit(False)).alias("hit"))


def recall(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: share of truth pairs proposed, and of entities all of whose truth is."""
    one = proposed(truth, pairs).groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("h"))
    return one.agg((F.sum("h") / F.sum("n")).alias("pair_recall"), F.avg((F.col("h") == F.col("n")).cast("double")).alias("entity_full_recall"))


def recall_detail(truth: DataFrame, pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """One row: recall as above, the share of entities without truth, and of those with truth but no candidate."""
    have = pairs.select("s1_id").distinct().select("s1_id", F.lit(1).alias("c"))
    one = entities.select("s1_id").join(truth.select("s1_id").distinct().select("s1_id", F.lit(1).alias("t")), "s1_id", "left").join(have, "s1_id", "left")
    shares = one.agg(F.avg(F.col("t").isNull().cast("double")).alias("singleton_share"), F.avg(F.when(F.col("t").isNotNull(), F.col("c").isNull().cast("double"))).alias("no_candidate_share"))
    return recall(truth, pairs).crossJoin(shares)  # one row by one row


def dangling(truth: DataFrame, s1: DataFrame, pool: DataFrame) -> DataFrame:
    """Truth pairs that name an unknown entity."""
    return truth.join(s1.select("s1_id"), "s1_id", "left_anti").unionByName(truth.join(s1.select("s1_id"), "s1_id", "left_semi").join(pool.select("pool_id"), "pool_id", "left_anti").select(*truth.columns))


def known_truth(truth: DataFrame, s1: DataFrame, pool: DataFrame) -> tuple[DataFrame, int]:
    """Truth pairs of known records, and how many pairs were dropped."""
    return truth.join(s1.select("s1_id"), "s1_id", "left_semi").join(pool.select("pool_id"), "pool_id", "left_semi").select(*truth.columns), dangling(truth, s1, pool).count()


def spot_check(labelled: DataFrame, truth: DataFrame, each: int = 3) -> None:
    """Looks up `each` rows of either label in truth again; raises if one is wrong or a label has no row."""
    for value in (1, 0):
        some = labelled.where(F.col("label") == value).select("s1_id", "pool_id").limit(each)
        right = {True: 0, False: 0} | {r["there"]: r["count"] for r in proposed(some, truth).withColumnRenamed("hit", "there").groupBy("there").count().collect()}
        if not right[True] + right[False]:
            raise ValueError(f"no row has label {value}")
        if right[not value]:
            raise ValueError(f"{right[not value]} rows of label {value} are wrong")


# Samples, by md5 so that they are the same anywhere


def bucket(id_col: str, seed: int, buckets: int) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col))), 1, 8), 16, 10).cast("long") % buckets


def _order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col)))


def _ranked(rows: DataFrame, by: list[str], seed: int) -> DataFrame:
    """Adds __rank within `by` in md5 order (then id), and __n, the group's rows.

    Rows are ranked inside cells of the hash's first digits; the counts of the
    cells before are added. So a group is never sorted in one task.
    """
    rows = rows.withColumn("__h", _order("s1_id", seed)).withColumn("__cell", F.substring("__h", 1, 4))
    cells = rows.groupBy(*by, "__cell").agg(F.count(F.lit(1)).alias("__c"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # at most 65,536 cells a group
    before = group.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*by, "__cell", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__before"), F.sum("__c").over(group).alias("__n"))
    keys = [*by, "__cell"]
    inside = Window.partitionBy(*keys).orderBy("__h", "s1_id")
    rows, cells = rows.withColumn("__r", F.row_number().over(inside)), cells.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    return rows.join(cells, match).withColumn("__rank", F.col("__r") + F.col("__before"))


def split(entities: DataFrame, fraction: float, seed: int = 0, stratum: str = "country_norm") -> DataFrame:
    """Adds `side`: in every stratum a share `fraction` (half to even) is held out for validation."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    held = F.col("__rank") <= F.bround(F.col("__n") * fraction)
    return _ranked(entities, [stratum], seed).select(*entities.columns, F.when(held, "validation").otherwise("train").alias("side"))


def subsample(entities: DataFrame, target: int, seed: int = 0, stratum: str = "country_norm") -> DataFrame:
    """`target` rows with a quota a stratum; rounding is made up from the rest. All rows if there are not more."""
    total = entities.count()
    if target <= 0 or target >= total:
        return entities
    late = (F.col("__rank") > F.bround(F.col("__n") * target / total)).alias("__late")
    quota = _ranked(entities, [stratum], seed).select(*entities.columns, late)
    early = quota.where("not __late").count()
    place = F.col("__rank") + F.when(F.col("__late"), early).otherwise(0)
    return _ranked(quota, ["__late"], seed).where(place <= target).select(*entities.columns)


def uniform_sample(entities: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """`target` entities without replacement, whatever their stratum."""
    return _ranked(entities, [], seed).where(F.col("__rank") <= target).select(*entities.columns)


def holdout(entities: DataFrame, fraction: float = 0.15, n_train: int = 100_000, n_validation: int = 50_000, seed: int = 0, stratum: str = "country_norm") -> tuple[DataFrame, DataFrame]:
    """A training and a validation sample of entities that share none; raises if they do."""
    sides = split(entities, fraction, seed, stratum)
    train, validation = (subsample(sides.where(F.col("side") == s).drop("side"), n, seed, stratum) for s, n in (("train", n_train), ("validation", n_validation)))
    if not train.select("s1_id").intersect(validation.select("s1_id")).isEmpty():
        raise ValueError("an entity is in both samples")
    return train, validation


def sample_negatives(labelled: DataFrame, per_entity: int = 20, seed: int = 0) -> DataFrame:
    """All positives and up to `per_entity` negatives of each entity, in one pass; an entity's rows are its candidates, which the cap bounds."""
    w = Window.partitionBy("s1_id", "label").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "s1_id", F.lit("/"), "pool_id")), "pool_id")
    return labelled.withColumn("__r", F.row_number().over(w)).where((F.col("label") == 1) | (F.col("__r") <= per_entity)).drop("__r")


def training_diagnostics(sampled: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: entities, positives, negatives, their ratio, and truth pairs that are no candidate."""
    counts = sampled.agg(F.count_distinct("s1_id").alias("entities"), F.count_if(F.col("label") == 1).alias("positives"), F.count_if(F.col("label") == 0).alias("negatives"))
    lost = proposed(truth.join(sampled.select("s1_id").distinct(), "s1_id", "left_semi"), sampled).agg(F.count_if(~F.col("hit")).alias("truth_not_proposed"))
    return counts.withColumn("negatives_per_positive", F.try_divide("negatives", "positives")).crossJoin(lost)  # one row by one row


def training_countries(norm: DataFrame, entities: DataFrame) -> list[str]:
    """Countries of the training entities and of the pool, without the empty one; never those of a test set."""
    own = entities.select("country_norm").unionByName(norm.where("source > 1").select("country_norm"))
    return sorted(r[0] for r in own.where("country_norm != ''").distinct().collect())  # one row a country


def early_stop(entities: DataFrame, share: int = 5, seed: int = 0) -> DataFrame:
    """Adds `early_stop`: true for `share` in 100 entities."""
    return entities.withColumn("early_stop", bucket("s1_id", seed, 100) < share)


# One owner


def resolve(claims: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Best claim of each pair, then one entity a pool record: the best score, the least id on ties."""
    best = claims.where(F.col("score") >= threshold).groupBy("s1_id", "pool_id").agg(F.max("score").alias("score"))
    owner = best.groupBy("pool_id").agg(F.min(F.struct((-F.col("score")).alias("less"), "s1_id")).alias("x"))  # summed up before the shuffle
    return owner.select("x.s1_id", "pool_id", (-F.col("x.less")).alias("score"))


# Metrics


def f05(n_true: Column, n_pred: Column, n_hit: Column) -> Column:
    """F with beta one half; 1 where nothing is true and nothing predicted, 0 where one is empty or nothing hits."""
    p, r = n_hit / n_pred, n_hit / n_true
    return F.when((n_true == 0) & (n_pred == 0), 1.0).when((n_true == 0) | (n_pred == 0) | (n_hit == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def f_beta(precision: Column, recall: Column, beta: float = 0.5) -> Column:
    """F of a precision and a recall; 1 where both are 0, as for nothing true and nothing predicted."""
    b = beta * beta
    return F.when((precision == 0) & (recall == 0), 1.0).otherwise((1 + b) * precision * recall / (b * precision + recall))


def entity_scores(entities: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """s1_id, n_true, n_pred, n_hit, f05 of every entity named anywhere."""
    t, q = truth.select("s1_id", "pool_id").distinct(), predicted.select("s1_id", "pool_id").distinct()
    both = t.select("*", F.lit(1).alias("t")).join(q.select("*", F.lit(1).alias("q")), ["s1_id", "pool_id"], "full_outer")
    counts = both.groupBy("s1_id").agg(F.count("t").alias("n_true"), F.count("q").alias("n_pred"), F.count_if(F.col("t").isNotNull() & F.col("q").isNotNull()).alias("n_hit"))
    out = entities.select("s1_id").union(t.select("s1_id")).union(q.select("s1_id")).distinct().join(counts, "s1_id", "left").na.fill(0)
    return out.withColumn("f05", f05(F.col("n_true"), F.col("n_pred"), F.col("n_hit")))


def summary(scores: DataFrame) -> DataFrame:
    """One row: macro F0.5, pair precision and recall, singleton accuracy, empty predictions."""
    return scores.agg(
        F.avg("f05").alias("macro_f05"),
        F.coalesce(F.try_divide(F.sum("n_hit"), F.sum("n_pred")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(F.sum("n_hit"), F.sum("n_true")), F.lit(0.0)).alias("recall"),
        F.avg(F.when(F.col("n_true") == 0, (F.col("n_pred") == 0).cast("double"))).alias("singleton_accuracy"),
        F.count_if(F.col("n_pred") == 0).alias("empty_predictions"),
    )


def subset_score(scores: DataFrame, subset: DataFrame) -> DataFrame:
    """The summary of the entities in `subset` (s1_id) alone."""
    return summary(scores.join(subset.select("s1_id").distinct(), "s1_id", "left_semi"))


def against_truth(entities: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: true and false positives, false negatives, precision and recall, over entities that truth names."""
    named = entities.select("s1_id").distinct()
    s = entity_scores(named, truth.join(named, "s1_id", "left_semi"), predicted.join(named, "s1_id", "left_semi"))
    tp, fp, fn = F.sum("n_hit"), F.sum(F.col("n_pred") - F.col("n_hit")), F.sum(F.col("n_true") - F.col("n_hit"))
    share = lambda a, b: F.coalesce(F.try_divide(a, a + b), F.lit(0.0))
    return s.agg(tp.alias("true_positives"), fp.alias("false_positives"), fn.alias("false_negatives"), share(tp, fp).alias("precision"), share(tp, fn).alias("recall"))


#: Grids of thresholds: of the first tuning 0.05 to 0.99, of the second 0.01 to 0.998.
COARSE_GRID = [round(0.05 + 0.005 * k, 3) for k in range(189)]
FINE_GRID = [round(0.01 + 0.002 * k, 3) for k in range(495)]


def sweep_by(claims: DataFrame, truth: DataFrame, entities: DataFrame, grid: list[float], resolve=resolve, metric=None) -> list[tuple[float, float]]:
    """(threshold, score) with a resolver and a metric of the caller's: resolve(claims, t) gives pairs, metric(scores) a number.

    One job a threshold; threshold_sweep() has the usual ones in one pass.
    """
    metric = metric or (lambda scores: scores.agg(F.avg("f05")).first()[0])
    return [(float(t), float(metric(entity_scores(entities, truth, resolve(claims, t))))) for t in sorted(grid)]


def threshold_sweep(claims: DataFrame, truth: DataFrame, entities: DataFrame, grid: list[float], owners: bool = True) -> DataFrame:
    """Macro F0.5 at every threshold of the grid, in one pass.

    The owner of a record is its best claim whatever the threshold, so claims
    are resolved once. Each is put at the highest grid value it passes; sums
    from the top down give every entity's counts at every value that changes
    them, and differences of its score add up over the grid.
    """
    spark = claims.sparkSession
    kept = resolve(claims) if owners else claims.groupBy("s1_id", "pool_id").agg(F.max("score").alias("score"))
    grid = sorted(grid)
    steps = F.array(*[F.lit(float(g)) for g in grid])
    at = F.size(F.filter(steps, lambda g: g <= F.col("score")))
    hit = label(kept, truth).select("s1_id", (at - 1).alias("k"), "label").where("k >= 0")
    cells = hit.groupBy("s1_id", "k").agg(F.count(F.lit(1)).alias("p"), F.sum("label").alias("h"))
    n_true = entities.select("s1_id").join(truth.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n_true")), "s1_id", "left").na.fill(0)
    w = Window.partitionBy("s1_id").orderBy(F.desc("k"))
    run = cells.join(n_true, "s1_id").select("s1_id", "k", "n_true", F.sum("p").over(w).alias("p"), F.sum("h").over(w).alias("h"))
    score = f05(F.col("n_true"), F.col("p"), F.col("h"))
    empty = F.when(F.col("n_true") == 0, 1.0).otherwise(0.0)
    change = run.select("k", (score - F.coalesce(F.lag(score).over(w), empty)).alias("d")).groupBy("k").agg(F.sum("d").alias("d"))
    base = n_true.agg(F.sum(empty).alias("base"), F.count(F.lit(1)).alias("n")).first()
    values = spark.createDataFrame([(k, float(g)) for k, g in enumerate(grid)], "k int, threshold double")
    down = Window.orderBy(F.desc("k"))  # one row a grid value
    out = values.join(change, "k", "left").select("threshold", F.sum(F.coalesce("d", F.lit(0.0))).over(down).alias("d"))
    return out.select("threshold", ((F.col("d") + F.lit(float(base["base"] or 0))) / F.lit(max(1, base["n"]))).alias("macro_f05"))


def best_threshold(sweep: DataFrame) -> tuple[float, float]:
    """Highest score, the lowest threshold on ties."""
    r = sweep.orderBy(F.desc("macro_f05"), "threshold").first()
    return r["threshold"], r["macro_f05"]


def errors(scores_truth: DataFrame, predicted: DataFrame, kind: str, top: int = 20) -> DataFrame:
    """The entities with the most false merges, missed pairs or singleton merges, by share."""
    t, q = (x.groupBy("s1_id").agg(F.array_sort(F.collect_set("pool_id")).alias(n)) for x, n in ((scores_truth, "t"), (predicted, "q")))
    none = F.array().cast("array<string>")
    both = t.join(q, "s1_id", "full_outer").select("s1_id", F.coalesce("t", none).alias("t"), F.coalesce("q", none).alias("q"))
    wrong = {"false_merges": F.array_except("q", "t"), "missed": F.array_except("t", "q"), "singleton_merges": F.when(F.size("t") == 0, F.col("q")).otherwise(none)}[kind]
    of = F.size("t") if kind == "missed" else F.size("q")
    rows = both.select("s1_id", wrong.alias("wrong"), of.alias("of")).where(F.size("wrong") > 0)
    return rows.select("s1_id", F.array_join("wrong", ",").alias("wrong"), (F.size("wrong") / F.col("of")).alias("share")).orderBy(F.desc("share"), "s1_id").limit(top)


def with_record_text(errors: DataFrame, norm: DataFrame) -> DataFrame:
    """Adds the name and core address of each entity in a list of worst errors, and those of its wrong records."""
    text = norm.select(F.col("entity_id").alias("id"), F.concat_ws(" | ", "name_norm", "address_core").alias("text"))
    wrong = errors.select("s1_id", F.explode(F.split("wrong", ",")).alias("id")).join(text, "id").groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "id", "text"))), "; ").alias("wrong_text"))
    own = text.select(F.col("id").alias("s1_id"), "text")
    return errors.join(own, "s1_id", "left").join(wrong, "s1_id", "left")


RULE = {"name_token_jaccard": 0.5, "name_char_jaccard": 0.3, "addr_token_jaccard": 0.1, "ctx_country_match": 0.1}


def rule_score(f: DataFrame) -> DataFrame:
    """A fixed score from native features, for runs without a trained model."""
    return f.select("s1_id", "pool_id", F.round(sum(w * F.col(c) for c, w in RULE.items()), 6).alias("score"))


# Delivered lists


WARNINGS = ("matches_outside_candidates",)


def id_rows(lists: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """s1_id and ids of a delivered file, without empty ids; null lists are empty."""
    return lists.select(F.col("source1_entity_id").alias("s1_id"), F.filter(F.split(F.coalesce(column, F.lit("")), ","), lambda x: x != "").alias("ids"))


def offenders(lists: DataFrame, entities: DataFrame, pool: DataFrame, column: str = "matched_entity_ids", candidates: DataFrame | None = None) -> dict[str, DataFrame]:
    """Of each check, what offends, as column x. `candidates` is a file of lists that must hold all matches."""
    rows = id_rows(lists, column)
    each = rows.select("s1_id", F.explode("ids").alias("pool_id"))
    pair = F.concat_ws(":", "s1_id", "pool_id").alias("x")
    out = {
        "duplicate_rows": rows.groupBy("s1_id").count().where("count > 1").select(F.col("s1_id").alias("x")),
        "duplicate_ids": rows.where(F.size("ids") > F.size(F.array_distinct("ids"))).select(F.col("s1_id").alias("x")).distinct(),
        "self_matches": each.where("s1_id = pool_id").select(F.col("s1_id").alias("x")),
        "bad_prefix": each.where(~F.col("pool_id").rlike("^S[23]-")).select(F.col("pool_id").alias("x")),
        "unknown_ids": each.join(pool.select("pool_id"), "pool_id", "left_anti").select(F.col("pool_id").alias("x")),
        "missing_entities": entities.select("s1_id").join(rows, "s1_id", "left_anti").select(F.col("s1_id").alias("x")),
        "extra_entities": rows.join(entities.select("s1_id"), "s1_id", "left_anti").select(F.col("s1_id").alias("x")),
    }
    if candidates is not None:
        held = id_rows(candidates, "candidate_entity_ids").select("s1_id", F.explode("ids").alias("pool_id")).distinct()
        out["matches_outside_candidates"] = each.distinct().join(held, ["s1_id", "pool_id"], "left_anti").select(pair)
    return out


def violations(lists: DataFrame, entities: DataFrame, pool: DataFrame, column: str = "matched_entity_ids", candidates: DataFrame | None = None) -> DataFrame:
    """(check, level, n, examples) of a delivered file of lists: errors, and warnings that do not make it wrong."""
    if lists.columns != ["source1_entity_id", column]:
        raise ValueError(f"the header is {lists.columns}")
    out = None
    for name, bad in offenders(lists, entities, pool, column, candidates).items():
        # The five least examples, by two-step ranking: no list of all offenders is gathered.
        few = bad.orderBy("x").limit(5).agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("examples"))
        level = "warning" if name in WARNINGS else "error"
        one = bad.agg(F.count(F.lit(1)).alias("n")).crossJoin(few).select(F.lit(name).alias("check"), F.lit(level).alias("level"), "n", "examples")  # one row by one row
        out = one if out is None else out.unionByName(one)
    return out


def validate(lists: DataFrame, entities: DataFrame, pool: DataFrame, column: str = "matched_entity_ids", candidates: DataFrame | None = None) -> tuple[list[str], list[str]]:
    """Messages of errors and of warnings; a file without errors may be delivered."""
    try:
        found = violations(lists, entities, pool, column, candidates).where("n > 0").orderBy("check").collect()  # one row a check
    except ValueError as wrong:
        return [str(wrong)], []
    say = lambda level: [f"{r['check']}: {r['n']} ({r['examples']})" for r in found if r["level"] == level]
    return say("error"), say("warning")
