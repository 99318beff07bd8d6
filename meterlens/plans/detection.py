"""The full anomaly run: three detectors, votes, severity."""

from __future__ import annotations

from pyspark.sql import DataFrame

from meterlens.config import TARGET, AnomalyParams
from meterlens.operators.anomalies import classify_severity, detect_zscore
from meterlens.operators.isolation import detect_isolation
from meterlens.operators.reconstruction import detect_reconstruction


def detect_anomalies(df: DataFrame, p: AnomalyParams = AnomalyParams()) -> DataFrame:
    """Isolation forest, z-score and reconstruction error on one table.

    Time features are used when the table has them. The deviation from the
    building mean comes with the z-score, so the building statistics are
    computed once.
    """
    inputs = [TARGET, *[c for c in ("hour", "day_of_week", "month") if c in df.columns]]
    isolated = detect_isolation(df, inputs, p=p)
    rebuilt = [*inputs, *[c for c in ("is_weekend",) if c in df.columns]]
    both = detect_reconstruction(
        detect_zscore(isolated, p.zscore_threshold), rebuilt, p.components
    )
    return classify_severity(both)
