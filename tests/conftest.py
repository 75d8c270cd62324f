import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from retentia import schema as S
from retentia.session import session


@pytest.fixture(scope="session")
def spark():
    built = session(
        "tests", master="local[4]", shuffle_partitions=4,
        **{"spark.ui.enabled": "false", "spark.driver.memory": "4g"},
    )
    built.sparkContext.setLogLevel("ERROR")
    yield built
    built.stop()


def customer(id, contract="One year", service="DSL", tenure=10, charge=50.0, total=500.0,
             churn=0, senior=0, payment="Mailed check", **other):
    """One customer record; unnamed features get plain values."""
    row = dict(
        customerID=id, gender="Male", SeniorCitizen=senior, Partner="No", Dependents="No",
        tenure=tenure, PhoneService="Yes", InternetService=service, Contract=contract,
        PaperlessBilling="Yes", PaymentMethod=payment, MonthlyCharges=charge,
        TotalCharges=total, Churn=churn,
    )
    return {**row, **other}


@pytest.fixture(scope="session")
def make(spark):
    """Frames from records: make.customers([...]), make.raw([...]), ..."""

    class Make:
        @staticmethod
        def frame(rows, schema):
            tuples = [tuple(r[f.name] for f in schema.fields) for r in rows]
            return spark.createDataFrame(tuples, schema)

        def customers(self, rows):
            return self.frame(rows, S.CUSTOMERS)

        def raw(self, rows):
            return self.frame(rows, S.RAW_CUSTOMERS)

        @staticmethod
        def transactions(rows):
            return spark.createDataFrame(rows, S.TRANSACTIONS)

        @staticmethod
        def tickets(rows):
            return spark.createDataFrame(rows, S.SUPPORT_TICKETS)

        @staticmethod
        def scores(pairs):
            return spark.createDataFrame(
                [(i, float(s), l, int(s >= 0.5)) for i, (s, l) in enumerate(pairs)],
                "id long, score double, label int, pred int",
            )

    return Make()


def rows(df):
    return [tuple(r) for r in df.collect()]
