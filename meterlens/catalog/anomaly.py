"""Queries on anomalies: z-scores, votes, rates and alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterlens.catalog.base import Query, rounded, selected, sql
from meterlens.operators import anomalies
from meterlens.operators.anomalies import add_group_stats

FLAG_NAMES = ["anomaly_zscore", "anomaly_hour", "anomaly_double"]

# Two more flags that SQL can express stand in for the learned detectors:
# far from the mean of the building and hour, and above twice the building mean.
FLAGGED_SQL = """
    select building_id, timestamp, meter_reading, zscore, deviation_pct,
           cast(case when abs(zscore) > 3 then 1 else 0 end as integer) as anomaly_zscore,
           cast(case when abs((meter_reading - hmean) / (hstd + 1e-8)) > 1.5 then 1 else 0 end
                as integer) as anomaly_hour,
           cast(case when deviation_pct > 100 then 1 else 0 end as integer) as anomaly_double
    from (select *, avg(meter_reading) over w as hmean, stddev_samp(meter_reading) over w as hstd
          from scored window w as (partition by building_id, hour(timestamp))) x"""
GRADED_SQL = f"""
    select *, anomaly_zscore + anomaly_hour + anomaly_double as anomaly_votes,
           cast(case when anomaly_zscore + anomaly_hour + anomaly_double >= 1 then 1 else 0 end
                as integer) as is_anomaly,
           case anomaly_zscore + anomaly_hour + anomaly_double
             when 3 then 'High' when 2 then 'Medium' when 1 then 'Low' else 'Normal' end
             as severity
    from ({FLAGGED_SQL}) f"""
COLUMNS = """building_id, timestamp, meter_reading, round(zscore, 6) + 0.0 as zscore,
    anomaly_zscore, round(deviation_pct, 6) + 0.0 as deviation_pct, anomaly_hour, anomaly_double,
    cast(anomaly_votes as integer) as anomaly_votes, is_anomaly, severity"""


def graded(s, d):
    scored = anomalies.detect_zscore(selected(s, d))
    hourly = add_group_stats(
        scored.withColumn("_hour", F.hour("timestamp")), ["building_id", "_hour"]
    )
    far = F.abs((F.col("meter_reading") - F.col("_mean")) / (F.col("_std") + 1e-8)) > 1.5
    flagged = hourly.select(
        *scored.columns,
        F.coalesce(far.cast("int"), F.lit(0)).alias("anomaly_hour"),
        (F.col("deviation_pct") > 100).cast("int").alias("anomaly_double"),
    )
    return anomalies.classify_severity(flagged, FLAG_NAMES)


ANOMALY = {
    "zscore_anomalies": Query(
        lambda s, d: rounded(anomalies.detect_zscore(selected(s, d))),
        sql("""select building_id, timestamp, meter_reading, round(zscore, 6) + 0.0 as zscore,
          cast(case when abs(zscore) > 3 then 1 else 0 end as integer) as anomaly_zscore,
          round(deviation_pct, 6) + 0.0 as deviation_pct from scored""", "scored"),
    ),
    "severity": Query(
        lambda s, d: rounded(graded(s, d)),
        sql(f"select {COLUMNS} from ({GRADED_SQL}) g", "scored"),
    ),
    "severity_counts": Query(
        lambda s, d: anomalies.severity_counts(graded(s, d)),
        sql(f"""select severity, count(*) as n from ({GRADED_SQL}) g
          where is_anomaly = 1 group by severity""", "scored"),
    ),
    "anomaly_rates": Query(
        lambda s, d: rounded(anomalies.anomaly_rates(graded(s, d), [*FLAG_NAMES, "is_anomaly"])),
        sql(" union all ".join(
            f"""select '{f}' as detector, cast(sum({f}) as bigint) as n,
              round(avg({f}) * 100, 6) as pct from ({GRADED_SQL}) g"""
            for f in (*FLAG_NAMES, "is_anomaly")), "scored"),
    ),
    "normal_readings": Query(
        lambda s, d: rounded(graded(s, d).filter(F.col("severity") == "Normal").select(
            "building_id", "timestamp", "meter_reading", "zscore")),
        sql(f"""select building_id, timestamp, meter_reading, round(zscore, 6) + 0.0 as zscore
          from ({GRADED_SQL}) g where severity = 'Normal'""", "scored"),
    ),
    "recent_alerts": Query(
        lambda s, d: rounded(anomalies.recent_alerts(graded(s, d))),
        sql(f"""select {COLUMNS} from (select * from ({GRADED_SQL}) g where is_anomaly = 1
          order by timestamp desc, building_id limit 10) t""", "scored"),
    ),
    "anomaly_timeline": Query(
        lambda s, d: rounded(anomalies.anomaly_timeline(graded(s, d))),
        sql(f"""select {COLUMNS} from (select * from ({GRADED_SQL}) g
          order by building_id, timestamp limit 5000) t""", "scored"),
    ),
}
