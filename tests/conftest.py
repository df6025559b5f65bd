import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from quantloom.session import build_session

    session = build_session(
        "local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.enabled": "false"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def walk(spark):
    """Two tickers of random-walk bars, 260 and 90 business days."""
    import numpy as np
    import pandas as pd

    rng = np.random.default_rng(42)
    frames = []
    for ticker, n in (("AAA", 260), ("BBB", 90)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
        dates = pd.bdate_range("2023-01-03", periods=n).date
        frames.append(
            pd.DataFrame(
                {"ticker": ticker, "date": dates, "open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": rng.integers(1_000_000, 5_000_000, n)}
            )
        )
    pdf = pd.concat(frames, ignore_index=True)
    return spark.createDataFrame(pdf), pdf
