"""Training and prediction from sources to delivered files, as one sequence of plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..storage import freed_shuffles, settle, write_json
from . import blocking, features, matching, model
from .normalise import normalise


@dataclass
class Options:
    """Parameters of a run; the defaults are those of a full one."""

    strategies: tuple[str, ...] = blocking.DEFAULT
    max_block: int = blocking.MAX_BLOCK
    cap: int = blocking.CAP
    fraction: float = 0.15
    n_train: int = 100_000
    n_validation: int = 50_000
    per_entity: int = 20
    rounds: int = 40
    depth: int = 6
    seed: int = 0
    grid: tuple[float, ...] = tuple(matching.FINE_GRID)


def entities_of(norm: DataFrame) -> DataFrame:
    return norm.where("source = 1").select(F.col("entity_id").alias("s1_id"), "country_norm")


def pool_of(norm: DataFrame) -> DataFrame:
    return norm.where("source > 1").select(F.col("entity_id").alias("pool_id"))


def load(spark: SparkSession, folder: str, split: str, cache: str | None = None) -> DataFrame:
    """Normalised records of a split of the data set, from the cache if it holds them."""
    norm = normalise(sources.read_sources(spark, folder, split))
    return sources.cached(norm, cache) if cache else norm


def candidates(norm: DataFrame, o: Options) -> DataFrame:
    with freed_shuffles(norm.sparkSession):
        return settle(blocking.candidates(norm, o.strategies, o.max_block, o.cap), "candidates")


def train(norm: DataFrame, truth: DataFrame, path: str, o: Options | None = None, pairs: DataFrame | None = None) -> dict:
    """Fits a matcher and its threshold on normalised records and truth pairs (s1_id, pool_id); saves both at `path`.

    Entities are split into two samples that share none. The threshold is the
    best of the grid on validation entities, with or without one owner a pool
    record, whichever scores higher; ties take the lower one, and owners.
    Truth pairs of unknown records are dropped and counted. `pairs` are the
    candidates of `norm` under `o`, if they are written already. Returns the
    report that is saved as report.json.
    """
    with freed_shuffles(norm.sparkSession):
        return _train(norm, truth, path, o or Options(), pairs)


def _train(norm: DataFrame, truth: DataFrame, path: str, o: Options, pairs: DataFrame | None) -> dict:
    spark = norm.sparkSession
    entities = entities_of(norm)
    truth, dropped = matching.known_truth(truth, entities, pool_of(norm))
    truth = settle(truth, "truth")
    pairs = candidates(norm, o) if pairs is None else pairs
    labelled = settle(matching.label(pairs, truth), "labelled")
    matching.spot_check(labelled, truth)
    fit, check = (settle(x, "sample") for x in matching.holdout(entities, o.fraction, o.n_train, o.n_validation, o.seed))
    countries = matching.training_countries(norm, fit)
    # Context counts are those of all candidates, but features are made of chosen rows only.
    counted = features.with_context(pairs, norm)
    own = lambda some, on, columns=None: features.features(settle(counted.join(some, on, "left_semi"), "context"), norm, countries, with_counts=False, columns=columns)
    picked = settle(matching.sample_negatives(labelled.join(fit.select("s1_id"), "s1_id", "left_semi"), o.per_entity, o.seed), "picked").select("s1_id", "pool_id", "label")
    sampled = own(picked, ["s1_id", "pool_id"]).join(picked, ["s1_id", "pool_id"])
    rows = settle(sampled.join(matching.early_stop(fit.select("s1_id"), seed=o.seed), "s1_id"), "training")
    fitted = model.train(rows, o.rounds, o.depth, o.seed)
    claims = settle(model.predict(fitted, own(check, ["s1_id"], model.used(fitted))), "claims")
    checked = truth.join(check.select("s1_id"), "s1_id", "left_semi")
    best = {owners: matching.best_threshold(matching.threshold_sweep(claims, checked, check, list(o.grid), owners)) for owners in (True, False)}
    owners = best[True][1] >= best[False][1]
    threshold = best[owners][0]
    chosen = decide(claims, threshold, owners)
    report = {
        "threshold": threshold,
        "one_owner": owners,
        "countries": countries,
        "dropped_truth": dropped,
        "validation": matching.summary(matching.entity_scores(check, checked, chosen)).first().asDict(),
        "macro_f05": {"one_owner": best[True][1], "many_owners": best[False][1]},
        "training": matching.training_diagnostics(rows, truth).first().asDict(),
        "recall": matching.recall_detail(truth, pairs, entities).first().asDict(),
        "importances": model.importances(fitted),
    }
    model.save(fitted, path, spark, threshold=threshold, one_owner=owners, countries=countries)
    write_json(spark, report, f"{path}/report.json")
    return report


def decide(claims: DataFrame, threshold: float, owners: bool) -> DataFrame:
    """The pairs that are delivered."""
    return matching.resolve(claims, threshold) if owners else claims.where(F.col("score") >= threshold)


def predict(norm: DataFrame, model_path: str, out: str | None = None, o: Options | None = None, blocks: int = 1, pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Match lists and candidate lists of normalised records by a saved model; with `out`, both are written there as files.

    With `blocks` over 1, scores are kept by block of entities under `out`, so
    that a run that was cut short goes on where it ended. Only features that
    the model uses are made. `pairs` as in train().
    """
    with freed_shuffles(norm.sparkSession):
        return _predict(norm, model_path, out, o or Options(), blocks, pairs)


def _predict(norm: DataFrame, model_path: str, out: str | None, o: Options, blocks: int, pairs: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    spark = norm.sparkSession
    fitted, about = model.load(model_path, spark)
    pairs = candidates(norm, o) if pairs is None else pairs
    asked = model.used(fitted)
    scored = lambda some, counted=True: model.predict(fitted, features.features(some, norm, about["countries"], with_counts=not counted, columns=asked)).where(F.col("score") >= about["threshold"])
    if out and blocks > 1:
        claims = sources.claims_in_blocks(spark, settle(features.with_context(pairs, norm), "context"), scored, f"{out}/claims", blocks, f"t={about['threshold']}")
    else:
        claims = scored(pairs, False)
    entities = entities_of(norm)
    lists = sources.id_lists(entities, decide(claims, about["threshold"], about["one_owner"]))
    held = sources.id_lists(entities, pairs, "candidate_entity_ids")
    if out:
        sources.write_lists(lists, f"{out}/matching_results")
        sources.write_lists(held, f"{out}/candidate_pairs")
        lists, held = (sources.read_lists(spark, f"{out}/{n}") for n in ("matching_results", "candidate_pairs"))
    return lists, held
