from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillbook.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, shuffle_partitions=8, app="tillbook-tests")
    yield s


LEDGER_DDL = ("expense_id long, expense_name string, expense_date date, expense_amount double, "
              "currency string, expense_in_ref_currency double, primary_category string, "
              "secondary_category string, year int, month int")


def ledger_rows():
    d = dt.date
    rows = [
        (1, "Rent", d(2026, 1, 1), 800.00, "Housing", "Rent"),
        (2, "Pam", d(2026, 1, 10), 50.50, "Groceries", "Supermarket"),
        (3, "Pam", d(2026, 2, 10), 49.50, "Groceries", "Supermarket"),
        (4, "Odd", d(2026, 2, 11), 10.00, "Custom", ""),
        (5, "Lost", d(2026, 2, 12), 5.00, None, None),
        (6, "Trap", d(2026, 2, 13), 7.00, "Total", "Total"),
    ]
    return [(i, n, day, a, "E", a, p, s, day.year, day.month) for i, n, day, a, p, s in rows]


@pytest.fixture()
def micro_ledger(spark):
    return spark.createDataFrame(ledger_rows(), LEDGER_DDL)


def rows_of(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
