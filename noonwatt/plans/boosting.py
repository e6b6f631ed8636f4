"""Forecasters that are fitted per key, and per fold of a key.

Boosted trees are Spark's own: every fit reads the rows of its key up to its gate, and its
statistics are added up by Spark, however long the history is. Fits of several keys and folds run
side by side; each one's forecasts are written before they are read together.

Own forecasters are functions of arrays, called in the tasks with the rows of one key and fold.
No fit sees rows of another key, so folds of keys that start at different times cannot leak
into each other.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noonwatt import vocab
from noonwatt.functions.numbers import clip_unit
from noonwatt.operators.reshape import complete_rows
from noonwatt.session import shared_folder
from noonwatt.sources.tables import write_table

TS = "utc_timestamp"
ZONE = ("zone",)
#: (training inputs, training target, inputs to predict) -> predictions.
Forecaster = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]
#: Fits that run side by side, and training rows of one partition.
PARALLEL, PARTITION_ROWS = 4, 20_000


@dataclass(frozen=True)
class Boosted:
    """Gradient boosted trees for squared error.

    The published results were made with 400 trees of step 0.05. A distributed fit takes a few
    jobs per tree, so the default is fewer trees with a longer step, of the same sum.
    """

    trees: int = vocab.GBT_TREES // 10
    step: float = vocab.GBT_STEP * 10
    depth: int = 5
    min_leaf: int = vocab.GBT_MIN_LEAF
    bins: int = 64
    seed: int = vocab.GBT_SEED

    def regressor(self) -> GBTRegressor:
        return GBTRegressor(
            featuresCol="inputs", labelCol="y", predictionCol="made", maxIter=self.trees, stepSize=self.step,
            maxDepth=self.depth, minInstancesPerNode=self.min_leaf, maxBins=self.bins, seed=self.seed,
            subsamplingRate=1.0, cacheNodeIds=False,
        )


#: What tells a fit's rows: (of the training rows, of the rows to predict).
Fit = tuple[Column, Column]


def predict_fits(
    train: DataFrame, rows: DataFrame, fits: Sequence[Fit], name: str, settings: Boosted = Boosted(),
    keys: Sequence[str] = ZONE, features: Sequence[str] = vocab.FEATURES,
) -> DataFrame:
    """(keys, timestamp, ``name`` bounded to [0, 1]): boosted trees, one ensemble per fit.

    Only rows with all inputs are learnt from or predicted. A fit without training rows
    predicts nothing.
    """
    spark = rows.sparkSession
    inputs = VectorAssembler(inputCols=list(features), outputCol="inputs")
    known = complete_rows(train, [vocab.TARGET, *features]).withColumn("y", F.col(vocab.TARGET).cast("double"))
    known = write_table(inputs.transform(known).drop(*features), spark, "known")
    asked = write_table(inputs.transform(complete_rows(rows, features)).drop(*features), spark, "asked")
    schema = asked.select(*keys, TS).schema.add(name, "double")
    folder = shared_folder(spark)

    def fit(number: int, of: Fit) -> str | None:
        seen, new = known.where(of[0]), asked.where(of[1])
        n = seen.count()
        if n == 0 or new.isEmpty():
            return None
        model = settings.regressor().fit(seen.select("inputs", "y").coalesce(-(-n // PARTITION_ROWS)))
        path = os.path.join(folder, f"fit-{number}")
        model.transform(new).select(*keys, TS, clip_unit("made").alias(name)).write.parquet(path)
        return path

    with ThreadPoolExecutor(PARALLEL) as pool:
        # Threads see the session's settings and job groups.
        jobs = [pool.submit(inheritable_thread_target(spark)(fit), i, of) for i, of in enumerate(fits)]
        paths = [p for p in (j.result() for j in jobs) if p is not None]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def boosted_per_key(
    train: DataFrame, rows: DataFrame, name: str, settings: Boosted = Boosted(), keys: Sequence[str] = ZONE,
    features: Sequence[str] = vocab.FEATURES,
) -> DataFrame:
    """``predict_fits`` with one fit for each key of ``rows``."""
    groups = rows.select(*keys).distinct().collect()  # one small row per series
    same = [reduce(and_, [F.col(k).eqNullSafe(F.lit(g[k])) for k in keys]) for g in groups]
    return predict_fits(train, rows, [(s, s) for s in same], name, settings, keys, features)


def predict_per_key(
    train: DataFrame,
    rows: DataFrame,
    forecasters: dict[str, Forecaster],
    keys: Sequence[str] = ZONE,
    features: Sequence[str] = vocab.FEATURES,
) -> DataFrame:
    """(keys, timestamp, a column per forecaster, bounded to [0, 1]) of ``rows``.

    One fit per key from the complete rows of ``train``. Rows of a key without training data,
    or without all inputs, are left out.
    """
    keys = list(keys)
    inputs = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)]
    known = complete_rows(train, [vocab.TARGET, *features]).select(
        *keys, F.col(TS), *inputs, F.col(vocab.TARGET).cast("double").alias("y"), F.lit(True).alias("known")
    )
    asked = complete_rows(rows, features).select(
        *keys, F.col(TS), *inputs, F.lit(None).cast("double").alias("y"), F.lit(False).alias("known")
    )
    names = [f"x{i}" for i in range(len(features))]

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        seen, new = group[group["known"]].sort_values(TS), group[~group["known"]]
        out = new[[*keys, TS]].copy()
        if not len(seen) or not len(new):
            return out.iloc[:0].assign(**dict.fromkeys(forecasters, 0.0))
        x, y, z = seen[names].to_numpy(), seen["y"].to_numpy(), new[names].to_numpy()
        for name, forecaster in forecasters.items():
            out[name] = np.clip(forecaster(x, y, z), 0.0, 1.0)
        return out

    schema = asked.select(*keys, TS).schema
    for name in forecasters:
        schema = schema.add(name, "double")
    return known.unionByName(asked).groupBy(*keys).applyInPandas(fit, schema)
