"""Prediction sets over a stream of probabilities, with thresholds calibrated beforehand.."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setcast.functions import kernels
from setcast.operators import conformal


def stream_sets(probs: DataFrame, tau: float, method: str = "SAPS", lam: float = 0.2, k_reg: int = 1) -> DataFrame:
    """probs(sample_id, u, p), streaming or not -> sample_id, members, size. Stateless: no watermark is needed."""
    scored = conformal.ranked(probs).withColumn("scores", conformal.scores(method, lam, k_reg))
    mask = kernels.within(F.col("scores"), F.lit(float(tau)))
    return scored.select("sample_id", kernels.members(mask).alias("members"), kernels.set_size(mask).alias("size"))
