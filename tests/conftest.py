import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from cspulse import schemas  # noqa: E402
from cspulse.session import build_session  # noqa: E402

AS_OF = dt.date(2024, 7, 29)
SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", app_name="cspulse-tests", shuffle_partitions=4)
    yield session
    session.stop()


def weeks_ago(n: int, days: int = 0) -> dt.date:
    """Date n weeks before AS_OF (plus ``days``)."""
    return AS_OF - dt.timedelta(days=7 * n) + dt.timedelta(days=days)


def customer(cid, plan="Starter", status="Active", mrr="50.00", signup=dt.date(2024, 1, 15),
             industry="SaaS"):
    return (cid, f"Co{cid}", signup, plan, industry, f"Owner{cid}", status,
            None if mrr is None else Decimal(mrr))


def activity(cid, date, logins=20, usage=50, tickets=0, nps=None, seq=0):
    aid = cid * 100000 + (date - dt.date(2020, 1, 1)).days * 10 + seq
    return (aid, cid, date, logins, usage, tickets, nps)


@pytest.fixture
def tables(spark):
    def make(customers, rows):
        return (spark.createDataFrame(customers, schemas.CUSTOMERS),
                spark.createDataFrame(rows, schemas.ACTIVITY))
    return make


def rows_by_id(df, key="customer_id"):
    return {r[key]: r.asDict() for r in df.collect()}
