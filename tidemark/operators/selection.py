"""Model selection over folds of keys: a key is in one fold, and every stage is fitted inside the fold."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(keys: list[Column], folds: int, seed: int = 0) -> Column:
    """A fold from 0 that depends on the keys and the seed alone; rows of one key are never apart."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(folds)).cast("int")


def cross_validate(df: DataFrame, stages: list, grid: list[dict], keys: list[str], label: str, folds: int = 3, parallel: int = 4, seed: int = 0, metric: str = "areaUnderROC") -> CrossValidatorModel:
    """Fits every setting of the grid on all folds but one, ``parallel`` at a time, and keeps the best on average.

    The feature stages are part of the estimator: what they learn (vocabularies, scales)
    comes from the training folds only.
    """
    marked = df.withColumn("_fold", fold([F.col(k) for k in keys], folds, seed))
    judge = BinaryClassificationEvaluator(labelCol=label, metricName=metric)
    search = CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol="_fold", parallelism=parallel)
    return search.fit(marked)
