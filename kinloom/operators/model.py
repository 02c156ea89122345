"""The matcher: gradient-boosted trees over the features, with a guard on column order."""

from __future__ import annotations

import re

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import exists, read_json, write_json
from .features import COLUMNS


def train(labelled: DataFrame, rounds: int = 40, depth: int = 6, seed: int = 0) -> PipelineModel:
    """Fits on rows with the features, `label` and, if there, `early_stop`; positives weigh negatives over positives."""
    n = {r["label"]: r["count"] for r in labelled.groupBy("label").count().collect()}
    if len(n) < 2:
        raise ValueError("training needs both classes")
    weighted = labelled.withColumn("__w", F.when(F.col("label") == 1, n[0] / n[1]).otherwise(1.0)).withColumn("label", F.col("label").cast("double"))
    gbt = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.05, subsamplingRate=0.9, featureSubsetStrategy="0.9", weightCol="__w", minInstancesPerNode=20, seed=seed)
    if "early_stop" in labelled.columns:
        gbt.setValidationIndicatorCol("early_stop")
    vectors = VectorAssembler(inputCols=COLUMNS, outputCol="features")
    return PipelineModel([vectors, gbt.fit(vectors.transform(weighted))])


def used(model: PipelineModel) -> list[str]:
    """The columns that any split asks for, in their order: scores depend on no other."""
    asked = set(map(int, re.findall(r"\(feature (\d+) ", model.stages[1].toDebugString)))
    return [c for k, c in enumerate(model.stages[0].getInputCols()) if k in asked]


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Scores of rows that have all columns, or those that the model uses."""
    if model.stages[0].getInputCols() != COLUMNS:
        raise ValueError("the model was trained on other columns")
    if lacking := set(used(model)) - set(rows.columns):
        raise ValueError(f"the model needs {sorted(lacking)}")
    rows = rows.withColumns({c: F.lit(0.0) for c in COLUMNS if c not in rows.columns})
    return model.transform(rows).select("s1_id", "pool_id", vector_to_array("probability")[1].alias("score"))


def save(model: PipelineModel, path: str, spark: SparkSession, **about) -> None:
    """The model, and beside it its columns in order and what else is to be known of it."""
    model.write().overwrite().save(f"{path}/model")
    write_json(spark, {"columns": model.stages[0].getInputCols(), **about}, f"{path}/columns.json")


def load(path: str, spark: SparkSession) -> tuple[PipelineModel, dict]:
    """The model and what was saved with it; without the list of columns, or with another one, it is refused."""
    if not exists(spark, f"{path}/columns.json"):
        raise FileNotFoundError(f"{path}/columns.json is missing: the order of columns is not known")
    about = read_json(spark, f"{path}/columns.json")
    if about["columns"] != COLUMNS:
        raise ValueError("the model was trained on other columns")
    return PipelineModel.load(f"{path}/model"), about


def importances(model: PipelineModel) -> list[tuple[str, float]]:
    pairs = zip(model.stages[0].getInputCols(), model.stages[1].featureImportances.toArray().tolist())
    return sorted(pairs, key=lambda x: (-x[1], x[0]))
