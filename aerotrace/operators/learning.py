"""Splits, weights, models and their measures, on Spark ML and plain aggregates."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from aerotrace.functions.geometry import category, clean, clip
from aerotrace.schema import FEATURES, LABELS, require_columns

SEED = 42


#: Ranges of hashes in which rows of a label are ranked apart.
HASH_BITS = 10


def split(df: DataFrame, key: list[str], share: float = 0.2, by: str | None = None, seed: int = SEED) -> DataFrame:
    """df with is_test: a fixed share by hash of the key, or exactly that share of every label if ``by`` is given.

    Without labels the hash decides row by row.  With them each label's rows are ranked by hash, in ranges of
    hashes whose counts are summed up, so no label's rows have to meet in one task.  A label's
    quota is its rounded share, but a row at least on either side; a label of one row is trained on.
    """
    if by is None:
        return df.withColumn("is_test", F.pmod(F.xxhash64(F.lit(seed), *(F.col(k) for k in key)), F.lit(1_000_000)) < int(share * 1_000_000))
    x = df.withColumns({"__label": F.struct(F.col(by)), "__hash": F.xxhash64(F.lit(seed), *(F.col(k) for k in key))})
    x = x.withColumn("__range", F.shiftright("__hash", 64 - HASH_BITS))
    every, ahead = W.partitionBy("__label"), W.partitionBy("__label").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sizes = x.groupBy("__label", "__range").agg(F.count("*").alias("__n"))  # at most 2**HASH_BITS rows a label
    total = F.sum("__n").over(every)
    sizes = sizes.select("__label", "__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__before"), F.greatest(F.lit(0), F.least(total - 1, F.greatest(F.lit(1), F.round(share * total).cast("long")))).alias("__quota"))
    x = x.withColumn("__rank", F.row_number().over(W.partitionBy("__label", "__range").orderBy("__hash", *key))).join(sizes, ["__label", "__range"])
    return x.withColumn("is_test", F.col("__before") + F.col("__rank") <= F.col("__quota")).select(*df.columns, "is_test")


def class_weights(df: DataFrame, column: str = "label") -> DataFrame:
    """label, n, weight = rows / (labels * rows of the label)."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))  # total is one row


def weighted(df: DataFrame, column: str = "label") -> DataFrame:
    return df.join(F.broadcast(class_weights(df, column).select(column, "weight")), column)


def cleaned(df: DataFrame, columns: list[str]) -> DataFrame:
    return require_columns(df, columns).withColumns({c: clean(F.col(c).cast("double")) for c in columns})


def train_classifier(df: DataFrame, columns: list[str] | None = None, label: str = "label", model_type: str = "random_forest", use_gpu: bool = False, trees: int = 200, depth: int | None = None) -> PipelineModel:
    """random_forest with balanced weights, or boosted: one boosted ensemble per label."""
    if use_gpu:
        raise ValueError("training runs on executors' CPUs; use_gpu isn't supported")
    columns = columns or FEATURES
    x = weighted(cleaned(df, columns), label)
    assemble = VectorAssembler(inputCols=columns, outputCol="features")
    if model_type == "random_forest":
        learner = RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=min(depth or 30, 30), minInstancesPerNode=2, seed=SEED)
    elif model_type == "boosted":
        learner = OneVsRest(labelCol=label, classifier=GBTClassifier(maxIter=trees, maxDepth=depth or 8, stepSize=0.1, subsamplingRate=0.9, seed=SEED))
    else:
        raise ValueError(f"unknown model_type {model_type}")
    return Pipeline(stages=[assemble, learner]).fit(x)


def predict(df: DataFrame, model: PipelineModel, columns: list[str] | None = None) -> DataFrame:
    """df with predicted_label and predicted_label_name; missing numbers count as 0."""
    columns = columns or FEATURES
    names = F.create_map(*(F.lit(v) for i, k in enumerate(LABELS) for v in (i, k)))
    x = model.transform(df.withColumns({f"__{c}": F.col(c) for c in columns}).withColumns({c: clean(F.col(c).cast("double")) for c in columns}))
    x = x.withColumns({c: F.col(f"__{c}") for c in columns}).withColumn("predicted_label", F.col("prediction").cast("int"))
    return x.withColumn("predicted_label_name", F.coalesce(F.try_element_at(names, F.col("predicted_label")), F.lit("Unknown"))).drop("features", "rawPrediction", "probability", "prediction", *(f"__{c}" for c in columns))


def importances(model: PipelineModel, columns: list[str], top: int = 15) -> list[tuple[str, float]]:
    pairs = zip(columns, model.stages[-1].featureImportances.toArray(), strict=True)
    return sorted(((n, float(v)) for n, v in pairs), key=lambda p: -p[1])[:top]


def train_regressor(df: DataFrame, columns: list[str], target: str = "score", kind: str = "ridge", alpha: float = 1.0, trees: int = 200) -> PipelineModel:
    x = cleaned(df, columns).withColumn(target, clip(clean(F.col(target))))
    assemble = VectorAssembler(inputCols=columns, outputCol="raw")
    scale = StandardScaler(inputCol="raw", outputCol="features", withMean=True)
    if kind == "ridge":
        learner = LinearRegression(labelCol=target, elasticNetParam=0.0, regParam=alpha / max(1, x.count()), standardization=False)
    elif kind == "boosted":
        learner = GBTRegressor(labelCol=target, maxIter=trees, maxDepth=6, stepSize=0.1, subsamplingRate=0.8, seed=SEED)
    else:
        raise ValueError(f"unknown model {kind}")
    return Pipeline(stages=[assemble, scale, learner]).fit(x)


def best_regressor(train: DataFrame, test: DataFrame, columns: list[str], target: str = "score", **options) -> tuple[str, PipelineModel, DataFrame]:
    """The kind of model with the least mean error on test, fitted, and both kinds' measures."""
    found = {}
    for kind in ("ridge", "boosted"):
        model = train_regressor(train, columns, target, kind, **options)
        found[kind] = (model, regression_metrics(score(test, model, columns), target, "advantage").withColumn("model", F.lit(kind)))
    metrics = found["ridge"][1].union(found["boosted"][1])
    kind = metrics.orderBy("mae").first()["model"]
    return kind, found[kind][0], metrics


def score(df: DataFrame, model: PipelineModel, columns: list[str]) -> DataFrame:
    """df with advantage in -1..1 and its category in two languages; batch or stream."""
    x = model.transform(cleaned(df, columns)).withColumn("advantage", clip(F.col("prediction"))).drop("raw", "features", "prediction")
    return x.withColumns({"category": category(F.col("advantage")), "category_ja": category(F.col("advantage"), japanese=True)})


def confusion(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """label, predicted, n: the filled cells of the confusion matrix."""
    return df.groupBy(label, predicted).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, labels: list[int], label: str = "label", predicted: str = "predicted") -> DataFrame:
    return df.groupBy(label).pivot(predicted, labels).count().na.fill(0)


def class_report(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """label, support, precision, recall, f1 of every label that stands on either side."""
    cells = confusion(df, label, predicted)
    rows = cells.select(F.col(label).alias("label"), F.col("n").alias("support"), F.lit(0).alias("said"), F.when(F.col(label) == F.col(predicted), F.col("n")).otherwise(0).alias("right"))
    columns = cells.select(F.col(predicted).alias("label"), F.lit(0).alias("support"), F.col("n").alias("said"), F.lit(0).alias("right"))
    x = rows.union(columns).groupBy("label").agg(*(F.sum(c).alias(c) for c in ("support", "said", "right")))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    x = x.withColumns({"precision": share(F.col("right"), F.col("said")), "recall": share(F.col("right"), F.col("support"))})
    return x.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("label", "support", "precision", "recall", "f1")


def class_metrics(df: DataFrame, label: str = "label", predicted: str = "predicted") -> DataFrame:
    """accuracy and precision, recall and f1 weighted by support."""
    report = class_report(df, label, predicted)
    weight = lambda c: F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0))
    # the share of right rows is the recall weighted by support
    return report.agg(weight("recall").alias("accuracy"), weight("precision").alias("precision"), weight("recall").alias("recall"), weight("f1").alias("f1"))


def regression_metrics(df: DataFrame, target: str = "score", predicted: str = "predicted", edge: float = 0.3) -> DataFrame:
    """mae, rmse, r2 and the share of rows on the same side of -edge and edge."""
    y, p = F.col(target), F.col(predicted)
    side = lambda c: F.when(c > edge, 1).when(c < -edge, -1).otherwise(0)
    return df.agg(F.avg(F.abs(y - p)).alias("mae"), F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"), (1 - F.try_divide(F.sum((y - p) * (y - p)), F.var_pop(y) * F.count(y))).alias("r2"), F.avg((side(y) == side(p)).cast("double")).alias("category_accuracy"))


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int = 50) -> DataFrame:
    """bin, n of a column's values between low and high: the data of a plot."""
    b = F.least(F.floor((F.col(column) - low) / (high - low) * bins), F.lit(bins - 1)).alias("bin")
    return df.filter((F.col(column) >= low) & (F.col(column) <= high)).groupBy(b).agg(F.count("*").alias("n"))


def save(model: PipelineModel, path: str, spark: SparkSession, columns: list[str], task: str) -> None:
    """The model, and beside it what it needs to be used, as JSON; both through Spark's file systems."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps({"columns": columns, "task": task, "labels": LABELS}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(path: str, spark: SparkSession) -> tuple[PipelineModel, dict]:
    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/about").first()["value"])
