"""Principal components."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.scale import fit_standard


@dataclass(frozen=True)
class Components:
    features: tuple[str, ...]
    centre: tuple[float, ...]
    spread: tuple[float, ...]
    model: object
    signs: tuple[float, ...]
    explained: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """Replaces the features by columns ``Component i``."""
        kept = [c for c in df.columns if c not in self.features]
        moved = [
            (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
            for c, m, s in zip(self.features, self.centre, self.spread)
        ]
        projected = self.model.transform(df.select(*kept, array_to_vector(F.array(*moved)).alias("moved_")))
        values = projected.select(*kept, vector_to_array("scores_").alias("scores_"))
        return values.select(
            *kept,
            *[(F.col("scores_")[i] * F.lit(s)).alias(f"Component {i}") for i, s in enumerate(self.signs)],
        )

    @property
    def names(self) -> list[str]:
        return [f"Component {i}" for i in range(len(self.signs))]


def fit_pca(df: DataFrame, cols: Sequence[str], k: int, standardize: bool = False) -> Components:
    """k components of the centred (optionally standardised) features.

    Signs are fixed so that the largest loading of each component is positive.
    """
    cols = tuple(cols)
    scaling = fit_standard(df, cols)
    centre = tuple(float(scaling.centre[c]) for c in cols)
    spread = tuple(float(scaling.spread[c] or 1.0) if standardize else 1.0 for c in cols)
    moved = [(F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(cols, centre, spread)]
    vectors = df.select(array_to_vector(F.array(*moved)).alias("moved_"))
    model = PCA(k=k, inputCol="moved_", outputCol="scores_").fit(vectors)
    loadings = model.pc.toArray()
    signs = tuple(float(np.sign(loadings[np.argmax(np.abs(loadings[:, j])), j]) or 1.0) for j in range(k))
    return Components(cols, centre, spread, model, signs, tuple(float(v) for v in model.explainedVariance))


def fit_pca_fraction(df: DataFrame, cols: Sequence[str], fraction: float, standardize: bool = False) -> Components:
    """Keeps ``int(fraction * columns)`` components."""
    return fit_pca(df, cols, int(fraction * len(cols)), standardize)
