"""Learned detectors: gradient-boosted trees on shape features, scored out of fold."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import grouped_folds
from .shapes import NAMES

LEAST_LABELLED = 50


def _model(features: list[str], trees: int, seed: int) -> Pipeline:
    filled = [f"{f}__v" for f in features]
    return Pipeline(stages=[
        Imputer(inputCols=features, outputCols=filled, strategy="median"), VectorAssembler(inputCols=[*filled, *(f"{f}__missing" for f in features)], outputCol="x"),
        GBTClassifier(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=3, stepSize=0.06, seed=seed),
    ])


def out_of_fold(features: DataFrame, labels: DataFrame, asset: str, k: int = 5, seed: int = 7, trees: int = 20, names: list[str] | None = None) -> DataFrame | None:
    """mp_id, detector, asset, score of each labelled meter, from the model of the folds it is not in.

    Whole partners are dealt to folds. Medians for missing values come from the training
    folds. None with fewer than 50 labels or one class only.
    """
    names = names or NAMES
    rows = labels.filter("y is not null").join(features, "mp_id").join(grouped_folds(labels, "gp", k, seed), "gp")
    rows = rows.withColumns({f"{f}__missing": F.when(F.col(f).isNull(), 1.0).otherwise(0.0) for f in names}).cache()
    n, pos = rows.agg(F.count("*"), F.sum("y")).first()
    if n < LEAST_LABELLED or not 0 < pos < n:
        return None
    out = None
    for fold in range(k):
        train = rows.filter(F.col("fold") != fold)
        # A feature that the training folds never have cannot be imputed.
        seen = train.agg(*(F.count(f).alias(f) for f in names)).first().asDict()
        model = _model([f for f in names if seen[f]], trees, seed).fit(train)
        found = model.transform(rows.filter(F.col("fold") == fold)).select("mp_id", F.lit(f"gbm_{asset}").alias("detector"), F.lit(asset).alias("asset"), vector_to_array("probability")[1].alias("score"))
        out = found if out is None else out.unionByName(found)
    return out
