"""Feature pipelines and models on pyspark.ml; chosen and sized by arguments."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier, GBTClassifier
from pyspark.ml.feature import IDF, CountVectorizer, FeatureHasher, MinMaxScaler, OneHotEncoder, StringIndexer, VarianceThresholdSelector, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.features import role_of


def feature_pipeline(df: DataFrame, *, vocab_size: int = 1000, min_df: float = 3, hash_size: int = 128, one_hot: tuple[str, ...] = (), embed: bool = False, scale: bool = True, variance: float | None = None, out: str = "features") -> Pipeline:
    """Stages for df's columns by role: token columns to TF-IDF (or Word2Vec), one_hot categories to vectors, the rest hashed."""
    by: dict[str, list[str]] = {}
    for c in df.columns:
        by.setdefault(role_of(c), []).append(c)
    stages, parts = [], []
    for c in by.get("token", []):
        if embed:
            stages.append(Word2Vec(inputCol=c, outputCol=f"{c}_emb_vec", vectorSize=30, minCount=5, seed=46))
            parts.append(f"{c}_emb_vec")
        else:
            stages += [CountVectorizer(inputCol=c, outputCol=f"{c}_tf", vocabSize=vocab_size, minDF=min_df), IDF(inputCol=f"{c}_tf", outputCol=f"{c}_tfidf")]
            parts.append(f"{c}_tfidf")
    for c in one_hot:
        stages += [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep"), OneHotEncoder(inputCol=f"{c}_index", outputCol=f"{c}_hot", handleInvalid="keep")]
        parts.append(f"{c}_hot")
    hashed = [c for c in by.get("category", []) + by.get("continuous", []) if c not in one_hot]
    if hashed:
        stages.append(FeatureHasher(inputCols=hashed, outputCol="_hashed", numFeatures=hash_size, categoricalCols=[c for c in hashed if role_of(c) == "category"]))
        parts.append("_hashed")
    parts += by.get("vector", [])
    last = "_assembled"
    stages.append(VectorAssembler(inputCols=parts, outputCol=last, handleInvalid="keep"))
    if variance is not None:
        stages.append(VarianceThresholdSelector(featuresCol=last, outputCol="_selected", varianceThreshold=variance))
        last = "_selected"
    if scale:
        stages.append(MinMaxScaler(inputCol=last, outputCol=out))
    else:
        stages[-1].setOutputCol(out)
    return Pipeline(stages=stages)


def classifier(kind: str = "gbt", label: str = "click_yn", features: str = "features", iterations: int = 50, depth: int = 4, weight: str | None = None, seed: int = 42):
    """'gbt' or 'fm'; the boosted-tree libraries outside Spark have no counterpart here and map to 'gbt'."""
    if kind == "fm":
        return FMClassifier(labelCol=label, featuresCol=features, maxIter=iterations, seed=seed)
    more = {"weightCol": weight} if weight else {}
    return GBTClassifier(labelCol=label, featuresCol=features, maxIter=iterations, maxDepth=depth, seed=seed, **more)


def regressor(label: str = "res_utility", features: str = "features", iterations: int = 50, depth: int = 4, seed: int = 42) -> GBTRegressor:
    return GBTRegressor(labelCol=label, featuresCol=features, maxIter=iterations, maxDepth=depth, seed=seed)


def score(model, df: DataFrame, out: str) -> DataFrame:
    """df with the probability of class 1."""
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def propensity(click: DataFrame, gap: DataFrame, keys: list[str]) -> DataFrame:
    """Product of both models' probabilities, to four places."""
    both = click.select(*keys, "prob_click").join(gap.select(*keys, "prob_gap"), keys)
    return both.withColumn("propensity_score", F.round(F.col("prob_click") * F.col("prob_gap"), 4))
