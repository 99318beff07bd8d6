"""Reconstruction-error detector on principal components."""

from __future__ import annotations

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlens.functions.scalars import total
from meterlens.operators.scores import add_standardised, error_threshold, fit_scaler


def detect_reconstruction(df: DataFrame, features: list[str], components: int = 2) -> DataFrame:
    """Add ``recon_error`` and ``anomaly_ae`` (error above mean + 2 std).

    Rows are standardised and rebuilt from the first components. The component
    matrix has one row per feature, so the rebuilding is column arithmetic
    that stays in generated code.
    """
    plain = df.select("*", *[F.col(f).cast("double").alias(f"_x_{f}") for f in features])
    inputs = [f"_x_{f}" for f in features]
    scaled = add_standardised(plain, inputs, fit_scaler(plain, inputs))
    names = [f"_x_{f}_scaled" for f in features]
    vectors = VectorAssembler(inputCols=names, outputCol="_v").transform(scaled)
    loadings = PCA(k=components, inputCol="_v", outputCol="_p").fit(vectors).pc.toArray()
    codes = [
        total([F.col(n) * float(loadings[i, k]) for i, n in enumerate(names)])
        for k in range(components)
    ]
    coded = scaled.select("*", *[c.alias(f"_c{k}") for k, c in enumerate(codes)])
    gaps = []
    for i, name in enumerate(names):
        rebuilt = total([F.col(f"_c{k}") * float(loadings[i, k]) for k in range(components)])
        gaps.append((F.col(name) - rebuilt) * (F.col(name) - rebuilt))
    with_error = coded.select(*df.columns, (total(gaps) / len(names)).alias("recon_error"))
    limit = error_threshold(with_error, "recon_error").scalar()
    return with_error.withColumn("anomaly_ae", (F.col("recon_error") > limit).cast("int"))
