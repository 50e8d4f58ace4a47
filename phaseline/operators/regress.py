"""Logistic regression on covariate patterns.

Rows with equal covariates are counted first, so the design is one row a
pattern; Newton steps then run on the sums of its information matrix.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the package


def logit(df: DataFrame, outcome: str, columns: list[str], iterations: int = 30, ridge: float = 1e-9) -> DataFrame:
    """(term, beta, se, z): Wald statistics of a logistic regression with a constant.

    Each step sums the gradient and the information matrix over the patterns in
    Arrow batches; p + p * p sums, never rows, reach the driver.
    """
    spark, names = df.sparkSession, ["const", *columns]
    size = len(names)
    g = df.groupBy(*(F.col(c).cast("double").alias(c) for c in columns)).agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum(F.col(outcome).cast("double")).alias("_y")).persist()
    beta, info = np.zeros(size), np.eye(size)

    def sums(at: np.ndarray):
        def run(batches):
            import pyarrow as pa

            total = np.zeros(size + size * size)
            for b in batches:
                cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
                x = np.column_stack([np.ones(len(b)), *cols[:-2]])
                n, y = cols[-2:]
                mu = 1 / (1 + np.exp(-(x @ at)))
                total[:size] += x.T @ (y - n * mu)
                total[size:] += (x.T @ (x * (n * mu * (1 - mu))[:, None])).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

        rows = g.mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).orderBy("k").collect()
        flat = np.array([r.v for r in rows])
        return flat[:size], flat[size:].reshape(size, size)

    for _ in range(iterations):
        grad, info = sums(beta)
        info = info + ridge * np.eye(size)
        step = np.linalg.solve(info, grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    g.unpersist()
    se = np.sqrt(np.diag(np.linalg.inv(info)))
    return spark.createDataFrame([(n, float(b), float(s), float(b / s)) for n, b, s in zip(names, beta, se)], "term string, beta double, se double, z double")
