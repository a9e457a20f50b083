"""Training and applying classifiers on feature arrays (L3, L4, L8): forests, linear heads, nearest centroids.

Checkpoints are chosen in ``metrics`` (L9); training from split to metrics (L6) and predictions that check a model's record (L5)
are in ``runs``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F

from granary.operators.metrics import class_weights
from granary.schemas import STAGES
from granary.session import bounded, cut


def weighted(rows: DataFrame, label: str) -> DataFrame:
    """Rows with the balanced ``weight`` of their label; labels are few, so their table is small."""
    return rows.join(class_weights(rows, label).select(label, "weight"), label)


def train(rows: DataFrame, features: str, label: str, kind: str = "random_forest", trees: int = 300, seed: int = 42, classes: tuple[str, ...] = STAGES, depth: int = 30) -> PipelineModel:
    """A balanced forest (sqrt features) or a multinomial linear head; classes are indexed in the given order.

    ``depth`` bounds the forest's trees; 30 is the most Spark allows, where the reference sets no bound. Splits are at most 32
    bins a feature.
    """
    indexer = StringIndexer(inputCol="__label", outputCol="label", handleInvalid="error").fit(rows.sparkSession.createDataFrame([(f"{i}:{c}",) for i, c in enumerate(classes)], "__label string"))
    order = reduce(lambda acc, ic: F.when(F.col(label) == ic[1], f"{ic[0]}:{ic[1]}").otherwise(acc), enumerate(classes), F.lit(None).cast("string"))
    data = weighted(rows, label).withColumn("__label", order).withColumn("features", array_to_vector(F.col(features)))
    if kind == "random_forest":
        model = RandomForestClassifier(numTrees=trees, featureSubsetStrategy="sqrt", weightCol="weight", seed=seed, maxDepth=depth)
    else:
        model = LogisticRegression(family="multinomial", weightCol="weight", regParam=1e-4, maxIter=50)
    return Pipeline(stages=[indexer, model]).fit(data)


def predict(model: PipelineModel, rows: DataFrame, features: str, classes: tuple[str, ...] = STAGES) -> DataFrame:
    """Scores per class and the first class with the largest score."""
    out = model.stages[-1].transform(rows.withColumn("features", array_to_vector(F.col(features))))
    p = vector_to_array("probability")
    scored = out.withColumn("__p", p)
    best = F.element_at(F.array(*[F.lit(c) for c in classes]), F.array_position("__p", F.array_max("__p")).cast("int"))
    return scored.select(*rows.columns, best.alias("predicted_stage"), *[F.element_at("__p", i + 1).alias(f"score_{c}") for i, c in enumerate(classes)])


def nearest_centroid(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``(key, label, assigned, distance)``: the label whose mean vector is nearest, the smallest on a tie.

    Means are one aggregation over (label, position); there are as many means as labels, so they are gathered into one row,
    which is broadcast if its measured size allows. Rows with a null vector or label take no part in the means; null vectors get no row.
    """
    dims = rows.where(F.col(vector).isNotNull()).select(key, label, F.posexplode(vector).alias("__i", "__v"))
    means = dims.where(F.col(label).isNotNull()).groupBy(label, "__i").agg(F.avg(F.col("__v").cast("double")).alias("__m")).groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__m"))), lambda s: s["__m"]).alias("__mean"))
    table = means.agg(F.array_sort(F.collect_list(F.struct(label, "__mean"))).alias("__means"))
    square = F.transform("__means", lambda c: F.struct(F.aggregate(F.zip_with(c["__mean"], F.col(vector), lambda a, b: (a - b.cast("double")) * (a - b.cast("double"))), F.lit(0.0), lambda s, x: s + x).alias("d"), c[label].alias("l")))
    return rows.where(F.col(vector).isNotNull()).crossJoin(bounded(cut(table))).select(key, label, F.array_min(square).alias("b")).select(key, label, F.col("b.l").alias("assigned"), F.col("b.d").alias("distance"))
