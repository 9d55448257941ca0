"""Global two-head demand learner on Spark ML.

One model for all series: a classifier for whether demand occurs and a
regressor for its size given that it occurs, both on the same per-quarter
features; the forecast is probability x size.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from partcast.functions.smoothing import extend
from partcast.operators.quantiles import exact_quantiles

LAGS = (1, 2, 3, 4)
ROLLS = (2, 4)
MIN_POSITIVES = 50


def feature_exprs(history: str, lags=LAGS, rolls=ROLLS) -> dict[str, str]:
    """Features of the next quarter from the array of past quarters.

    Same definitions as the windowed features, stated on the history array so
    that a forecast can append to it and go on.
    """
    n = f"size({history})"
    out = {f"x_lag{k}": f"if({n} >= {k}, element_at({history}, -least({k}, greatest({n}, 1))), 0.0D)" for k in lags}
    for w in rolls:
        tail = f"slice({history}, -least({w}, greatest({n}, 1)), {w})"
        m = f"aggregate({tail}, 0.0D, (s, x) -> s + x) / greatest(size({tail}), 1)"
        out[f"x_mean{w}"] = m
        out[f"x_std{w}"] = (f"sqrt(aggregate({tail}, 0.0D, (s, x) -> s + (x - x_mean{w}) * (x - x_mean{w}))"
                            f" / greatest(size({tail}), 1))")
        out[f"x_nz{w}"] = f"CAST(size(filter({tail}, x -> x > 0)) AS DOUBLE)"
    pos = f"filter({history}, x -> x > 0)"
    out["x_n"] = f"CAST(size({pos}) AS DOUBLE)"
    out["x_size"] = f"if(x_n > 0, aggregate({pos}, 0.0D, (s, x) -> s + x) / greatest(x_n, 1.0D), 0.0D)"
    out["x_since"] = (f"CAST({n} - aggregate(sequence(1, greatest({n}, 1)), 0, "
                      f"(s, i) -> if(i <= {n} AND {history}[i - 1] > 0, i, s)) AS DOUBLE)")
    return out


def training_table(panel: DataFrame, train: int, statics: list[str], first: int = 4) -> DataFrame:
    """One row per series and quarter: features from earlier quarters, the target,
    and a validation flag for the newest 15 % of quarters."""
    cut = train - max(round(0.15 * (train - first)), 1)
    rows = panel.select(*statics, F.slice("y", 1, train).alias("y"), F.explode(F.sequence(F.lit(first), F.lit(train - 1))).alias("t"))
    rows = rows.selectExpr(*statics, "t", "slice(y, 1, t) AS hist", "y[t] AS target", f"t >= {cut} AS valid")
    return extend(rows, feature_exprs("hist")).drop("hist")


def feature_names(statics: list[str]) -> list[str]:
    return list(feature_exprs("h")) + statics


class TwoHead:
    """Fitted classifier and size regressor (None below 50 positive rows)."""

    def __init__(self, occurs: PipelineModel, size: PipelineModel | None, statics: list[str]):
        self.occurs, self.size, self.statics = occurs, size, statics

    @classmethod
    def fit(cls, panel: DataFrame, train: int, statics: list[str], trees: int = 10, depth: int = 4, seed: int = 42) -> "TwoHead":
        table = training_table(panel, train, statics).persist()
        try:
            vec = VectorAssembler(inputCols=feature_names(statics), outputCol="features")
            clf = GBTClassifier(labelCol="occurs", maxIter=trees, maxDepth=depth, seed=seed, validationIndicatorCol="valid",
                                predictionCol="pred_occurs")
            clf = clf.setRawPredictionCol("raw_occurs").setProbabilityCol("prob_occurs")
            reg = GBTRegressor(labelCol="target", maxIter=trees, maxDepth=depth, seed=seed,
                               validationIndicatorCol="valid", predictionCol="pred_size")
            labelled = table.withColumn("occurs", F.expr("if(target > 0, 1.0D, 0.0D)"))
            occurs = Pipeline(stages=[vec, clf]).fit(labelled)
            positive = labelled.where("target > 0")
            n = positive.limit(MIN_POSITIVES).count()
            size = Pipeline(stages=[vec, reg]).fit(positive) if n >= MIN_POSITIVES else None
        finally:
            table.unpersist()
        return cls(occurs, size, statics)

    def step(self, df: DataFrame, history: str = "hist") -> DataFrame:
        """Add p_occurs, size_hat and mean_hat for the quarter after ``history``."""
        x = extend(df, feature_exprs(history))
        x = self.occurs.transform(x).withColumn("p_occurs", vector_to_array("prob_occurs")[1])
        x = x.drop("features", "raw_occurs", "prob_occurs", "pred_occurs")
        if self.size is None:
            x = x.withColumn("size_hat", F.lit(0.0))
        else:
            x = self.size.transform(x).withColumn("size_hat", F.greatest("pred_size", F.lit(0.0))).drop("features", "pred_size")
        return x.withColumn("mean_hat", F.col("p_occurs") * F.col("size_hat")).drop(*feature_exprs(history))

    def recursive(self, panel: DataFrame, train: int, horizon: int) -> DataFrame:
        """Predict, append the prediction to the history, repeat."""
        df = panel.withColumn("hist", F.slice("y", 1, train)).withColumn("path", F.array().cast("array<double>"))
        for i in range(horizon):
            df = self.step(df)
            if i == 0:
                df = df.withColumns({"first_p": F.col("p_occurs"), "first_size": F.col("size_hat")})
            df = df.withColumns({
                "hist": F.concat("hist", F.array("mean_hat")), "path": F.concat("path", F.array("mean_hat")),
            }).drop("p_occurs", "size_hat", "mean_hat")
        return df.drop("hist")

    def importances(self, spark) -> DataFrame:
        """Feature importance of both heads, largest first."""
        rows = []
        for head, model in (("occurs", self.occurs), ("size", self.size)):
            if model is not None:
                vec = model.stages[-1].featureImportances
                rows += [(head, n, float(v)) for n, v in zip(feature_names(self.statics), vec.toArray())]
        return spark.createDataFrame(rows, "head string, feature string, importance double").orderBy(
            F.col("importance").desc(), "head", "feature")


def size_quantiles(scored: DataFrame, levels: tuple[float, ...], predicted: str = "size_hat", actual: str = "target", edges: tuple[float, ...] = (2, 5, 10, 20, 40, 80)) -> DataFrame:
    """Conditional size quantiles: positives bucketed by predicted size, one
    exact quantile vector per bucket (buckets are fixed by ``edges``)."""
    cuts = "array(" + ", ".join(f"{float(e)}D" for e in edges) + ")"
    pos = scored.where(F.col(actual) > 0).withColumn("bucket", F.expr(f"size(filter({cuts}, e -> {predicted} >= e))"))
    q = exact_quantiles(pos, ["bucket"], actual, list(levels))
    return q.groupBy("bucket").agg(F.expr("transform(array_sort(collect_list(struct(prob, value))), e -> e.value) AS size_q"))
