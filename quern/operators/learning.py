"""Reductions, calibrated and penalised linear models, and deconvolution over Spark's own learners."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pca(df: DataFrame, vector: str, k: int, name: str = "components") -> DataFrame:
    """df with the k leading principal components of an array column (of at most some thousand places)."""
    v = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return PCA(k=k, inputCol="_v", outputCol="_c").fit(v).transform(v).withColumn(name, vector_to_array("_c")).drop("_v", "_c")


def platt_scale(df: DataFrame, score: str, label: str, fit_on: DataFrame | None = None, name: str = "calibrated") -> DataFrame:
    """df with the probability of a logistic fit of the 0/1 label on the score."""
    assemble = VectorAssembler(inputCols=[score], outputCol="_v", handleInvalid="skip")
    model = LogisticRegression(featuresCol="_v", labelCol=label, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y").fit(assemble.transform(fit_on or df))
    return model.transform(assemble.transform(df)).withColumn(name, vector_to_array("_p")[1]).drop("_v", "_p", "_r", "_y")


def cross_validated(df: DataFrame, features: Sequence[str], label: str, penalties: Sequence[float] = (0.0, 0.01, 0.1), mix: float = 1.0, folds: int = 3, parallelism: int = 4, seed: int = 42) -> tuple[float, float]:
    """(penalty, area under the curve) of the best penalty of a logistic model, by folds."""
    data = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip").transform(df)
    learner = LogisticRegression(featuresCol="_v", labelCol=label, elasticNetParam=mix)
    grid = ParamGridBuilder().addGrid(learner.regParam, list(penalties)).build()
    fitted = CrossValidator(estimator=learner, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(labelCol=label), numFolds=folds, parallelism=parallelism, seed=seed).fit(data)
    best = int(np.argmax(fitted.avgMetrics))
    return penalties[best], float(fitted.avgMetrics[best])


def stability_selection(df: DataFrame, features: Sequence[str], label: str, penalty: float, key: str, draws: int = 20, share: float = 0.5, threshold: float = 0.8, seed: int = 42) -> DataFrame:
    """feature, frequency, stable: in how many of the seeded half samples a lasso keeps the feature."""
    data = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip").transform(df)
    learner = LogisticRegression(featuresCol="_v", labelCol=label, elasticNetParam=1.0, regParam=penalty)
    kept = np.zeros(len(features))
    for i in range(draws):
        part = data.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(i), key), F.lit(1000)) < int(1000 * share))
        kept += np.abs(learner.fit(part).coefficients.toArray()) > 1e-9
    rows = [(f, float(n / draws), bool(n / draws >= threshold)) for f, n in zip(features, kept, strict=True)]
    return df.sparkSession.createDataFrame(rows, "feature string, frequency double, stable boolean")


def variance_inflation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """feature, vif: the diagonal of the inverse correlation matrix (of the features, not the rows)."""
    data = VectorAssembler(inputCols=list(features), outputCol="_v", handleInvalid="skip").transform(df)
    matrix = Correlation.corr(data, "_v").first()[0].toArray()
    return df.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(features, np.diag(np.linalg.pinv(matrix)), strict=True)], "feature string, vif double")


def non_negative_fit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 that brings a x nearest to b, by adding one column after another to the active set."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    for _ in range(3 * n + 1):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        if active.all() or gradient.max() <= 1e-10 * max(1.0, np.abs(b).max()):
            break
        active[int(gradient.argmax())] = True
        while True:
            z = np.zeros(n)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            bad = active & (z <= 0)
            if not bad.any():
                break
            step = np.min(x[bad] / (x[bad] - z[bad]))
            x = x + step * (z - x)
            active &= x > 1e-12
            x[~active] = 0
        x = z
    return x


def deconvolve(df: DataFrame, signatures: DataFrame, sample: str, member: str, value: str, kind: str, weight: str) -> DataFrame:
    """sample, kind, fraction: non-negative least squares of each sample's values on the kinds' signatures, as shares.

    One sample's values for the signature members are one group: their number is that of the
    signature, whatever the size of the corpus.
    """
    joined = df.join(signatures.select(member, kind, F.col(weight).alias("_w")), member).select(F.col(sample).alias("sample"), F.col(member).alias("member"), F.col(kind).cast("string").alias("kind"), F.col(value).cast("double").alias("value"), F.col("_w").cast("double").alias("w"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf.pivot_table(index="member", columns="kind", values="w", aggfunc="first").fillna(0.0)
        b = pdf.groupby("member")["value"].first().loc[table.index]
        x = non_negative_fit(table.to_numpy(), b.to_numpy())
        total = x.sum()
        return pd.DataFrame({"sample": pdf["sample"].iloc[0], "kind": table.columns, "fraction": x / total if total > 0 else x})

    out = joined.groupBy("sample").applyInPandas(fit, f"sample {dict(joined.dtypes)['sample']}, kind string, fraction double")
    return out.select(F.col("sample").alias(sample), F.col("kind").alias(kind), "fraction")
