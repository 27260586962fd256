"""Batch scoring, perturbations, Shapley values and uncertainty."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def batch_predict(df: DataFrame, key: str, vector: str, model: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = 64) -> DataFrame:
    """(key, prediction): ``model()`` is made once per task and gets ``batch`` vectors at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = model()
        for frame in frames:
            for i in range(0, len(frame), batch):
                part = frame.iloc[i : i + batch]
                yield pd.DataFrame({key: part[key], "prediction": predict(np.stack(part[vector].to_numpy()).astype(float))})

    kind = dict(df.dtypes)[key]
    return df.select(key, vector).where(F.col(vector).isNotNull()).mapInPandas(run, f"{key} {kind}, prediction double")


def linear(vector: Column, weights: Column, bias: float = 0.0) -> Column:
    """A linear model's prediction of an array, as an expression."""
    return F.aggregate(F.zip_with(vector, weights, lambda x, w: x.cast("double") * w), F.lit(bias), lambda s, x: s + x)


def counterfactuals(df: DataFrame, keys: list[str], changes: dict[str, tuple[str, str, float]], score: Callable[[Callable[[str], Column]], Column]) -> DataFrame:
    """(keys, change, effect): how a score moves when one feature is set, added to or multiplied; rows are read once."""
    base = score(F.col)
    out = []
    for name, (feature, how, by) in changes.items():
        moved = {"set": lambda c, by=by: F.lit(by), "add": lambda c, by=by: c + by, "multiply": lambda c, by=by: c * by}[how]
        new = score(lambda c, feature=feature, moved=moved: moved(F.col(c)) if c == feature else F.col(c))
        out.append(F.struct(F.lit(name).alias("change"), (new - base).alias("effect")))
    return df.select(*keys, F.inline(F.array(*out)))


def importance(df: DataFrame, shares: str) -> DataFrame:
    """(feature, importance): mean absolute share of each place of an array."""
    return df.select(F.posexplode(shares).alias("feature", "share")).groupBy("feature").agg(F.avg(F.abs("share")).alias("importance"))


def uncertainty(df: DataFrame, keys: list[str], prediction: str, scale: float) -> DataFrame:
    """Mean and population deviation of repeated passes, and a confidence of 1 at no deviation and 0 at ``scale``."""
    found = df.groupBy(*keys).agg(F.avg(prediction).alias("mean"), F.stddev_pop(prediction).alias("std"))
    return found.withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("std") / scale)))


def shapley(df: DataFrame, key: str, vector: str, model: Callable[[np.ndarray], np.ndarray], background: np.ndarray, samples: int = 256, seed: int = 42) -> DataFrame:
    """(key, values): Kernel SHAP of each row, by weighted least squares over coalitions; rows without a vector are left out.

    All coalitions of up to 8 features, else a seeded sample; the values add up
    to the prediction less that of the background. The coalitions are the same
    for all rows, so that the normal equations are solved once a task and rows
    are a product with that; ``model`` gets some 65,536 vectors at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(background)
        masks, solver = _coalitions(k, samples, seed)
        base, step = float(model(background[None])[0]), max(1, 65_536 // max(1, len(masks)))
        for frame in frames:
            values = []
            for i in range(0, len(frame), step):
                x = np.stack(frame[vector].iloc[i : i + step].to_numpy()).astype(float)
                full = model(x) - base
                y = model(np.where(masks > 0, x[:, None], background).reshape(-1, k)).reshape(len(x), len(masks)) - base
                # The last value follows from the sum.
                head = (y - masks[:, -1] * full[:, None]) @ solver.T
                values += np.column_stack([head, full - head.sum(axis=1)]).tolist()
            yield pd.DataFrame({key: frame[key], "values": values})

    return df.select(key, vector).where(F.col(vector).isNotNull()).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, values array<double>")


def _coalitions(k: int, samples: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions as rows of 0 and 1, and the matrix that takes their values to those of all features but the last."""
    if k <= 8:
        masks = ((np.arange(1, 2**k - 1)[:, None] >> np.arange(k)) & 1).astype(float)
    else:
        rng = np.random.default_rng(seed)
        sizes = rng.integers(1, k, samples)
        masks = np.array([np.isin(np.arange(k), rng.choice(k, s, replace=False)) for s in sizes], float)
    size = masks.sum(axis=1).astype(int)
    weight = np.array([(k - 1) / (comb(k, s) * s * (k - s)) for s in size])
    a = masks[:, :-1] - masks[:, -1:]
    aw = a * weight[:, None]
    return masks, np.linalg.pinv(aw.T @ a) @ aw.T
