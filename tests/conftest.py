import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from equiaudit.session import local_session  # noqa: E402

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paths import CREDIT_CSV  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, extra={"spark.sql.shuffle.partitions": "8"})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def credit(spark):
    """250 scored credit rows with their 20 features (scored columns first)."""
    import pandas as pd

    df = pd.read_csv(CREDIT_CSV)
    feats = list(df.columns[6:])
    return spark.createDataFrame(df), feats
