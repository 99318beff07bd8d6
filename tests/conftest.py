import numpy as np
import pandas as pd
import pytest

from meterlens.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def frame() -> pd.DataFrame:
    """Two long buildings, one single-row and one constant; gaps in time.

    Building 1 holds far more rows than the others, as a hot key would.
    """
    random = np.random.default_rng(7)
    parts = []
    for building, hours in ((1, 900), (2, 250), (3, 1), (4, 60)):
        ts = pd.date_range("2016-01-01", periods=hours, freq="h")
        values = np.round(random.gamma(2.0, 30.0, hours), 2) if building != 4 else np.full(hours, 5.0)
        parts.append(pd.DataFrame({"building_id": building, "timestamp": ts, "meter_reading": values}))
    df = pd.concat(parts, ignore_index=True)
    keep = random.random(len(df)) > 0.1
    keep |= df["building_id"].isin([3, 4]).to_numpy()
    return df[keep].reset_index(drop=True)


SCHEMA = "building_id long, timestamp timestamp_ntz, meter_reading double"


@pytest.fixture(scope="session")
def readings(spark, frame):
    return spark.createDataFrame(frame, SCHEMA).persist()


def rows(df, *order) -> pd.DataFrame:
    return df.toPandas().sort_values(list(order)).reset_index(drop=True)
