"""Classifier heads by pyspark.ml: not the same numbers as a gradient-trained network, but the same role."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstrand.shared import free_name, stash

#: Sizes of the three hidden layers for fewer than so many classes, and for any more.
HIDDEN = ((100, (512, 128, 64)), (1000, (512, 256, 128)))
HIDDEN_OF_MANY = (512, 128, 32)


def hidden_sizes(classes: int) -> tuple[int, int, int]:
    return next((sizes for below, sizes in HIDDEN if classes < below), HIDDEN_OF_MANY)


def _ready(df: DataFrame, vector: str) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))


def logistic_head(train: DataFrame, test: DataFrame, vector: str, label: str, weight: str | None = None, rounds: int = 50) -> DataFrame:
    """test with logits and pred."""
    head = LogisticRegression(featuresCol="features", labelCol=label, maxIter=rounds, regParam=0.01, **({"weightCol": weight} if weight else {}))
    out = head.fit(_ready(train, vector)).transform(_ready(test, vector))
    return out.select(*test.columns, vector_to_array("rawPrediction").alias("logits"), F.col("prediction").cast("int").alias("pred"))


def perceptron_head(train: DataFrame, test: DataFrame, vector: str, label: str, classes: int, hidden: tuple[int, ...] | None = None, rounds: int = 50, seed: int = 42) -> DataFrame:
    """test with logits and pred, by a network of sigmoid layers as large as hidden_sizes(classes) unless hidden is given.

    Labels are 0 to classes - 1; rows of train with another label, without a label or without a vector don't count, rows of
    test without a vector have no logits. Places are scaled to mean 0 and deviation 1 over train (those that never change to
    0), since sigmoids learn little from others. Each round is one pass over the table that train is written to; tasks hand
    on a gradient, so the driver holds the network and no rows.
    """
    own = stash(_ready(train.where(F.col(label).between(0, classes - 1) & F.col(vector).isNotNull()), vector).select(F.col(label).cast("double").alias("label"), "features"), "perceptron-rows")
    scaler = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(own)
    layers = [scaler.mean.size, *(hidden or hidden_sizes(classes)), classes]
    model = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="label", layers=layers, maxIter=rounds, seed=seed).fit(scaler.transform(own))
    at = {n: free_name(n, test) for n in ("features", "scaled", "raw", "probability", "prediction")}
    known = test.where(F.col(vector).isNotNull())
    rows = known.withColumn(at["features"], array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = model.setFeaturesCol(at["scaled"]).setRawPredictionCol(at["raw"]).setProbabilityCol(at["probability"]).setPredictionCol(at["prediction"])
    out = model.transform(scaler.setInputCol(at["features"]).setOutputCol(at["scaled"]).transform(rows))
    scored = out.select(*test.columns, vector_to_array(at["raw"]).alias("logits"), F.col(at["prediction"]).cast("int").alias("pred"))
    without = test.where(F.col(vector).isNull())
    return scored.unionByName(without.select("*", F.lit(None).cast("array<double>").alias("logits"), F.lit(None).cast("int").alias("pred")))
