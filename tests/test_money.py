from tillbook.operators import cashflow as C
from tillbook.operators import networth as N


def test_cashflow_golden(spark, micro_ledger):
    income = spark.createDataFrame([("Salary", 2026, 1, 1000.0)],
                                   "category string, year int, month int, value double")
    st = {(r.month, r.category): r.value for r in C.cashflow_statement(income, micro_ledger).collect()}
    assert (st[(1, "Income")], st[(1, "Spending")], st[(1, "Saving")], st[(1, "Saving %")]) == \
        (1000.0, 850.5, 149.5, 14.95)
    assert (st[(2, "Income")], st[(2, "Spending")], st[(2, "Saving")], st[(2, "Saving %")]) == \
        (0.0, 59.5, -59.5, 0.0)
    assert all(st[(m, c)] == 0.0 for m in range(3, 13)
               for c in ["Salary", "Other", "Income", "Spending", "Saving", "Saving %"])
    assert len(st) == 12 * 8


def test_cashflow_bars_and_income_share(spark, micro_ledger):
    income = spark.createDataFrame([("Salary", 2026, 1, 1000.0), ("Other", 2026, 2, -5.0),
                                    ("Bonus", 2026, 3, 9.0)],
                                   "category string, year int, month int, value double")
    bars = C.cashflow_bars(income, micro_ledger)
    assert bars.count() == 36
    share = {r.category: r.value for r in C.income_share(income).collect()}
    assert share == {"Salary": 1000.0}


def test_cashflow_bars_empty_year(spark, micro_ledger):
    income = spark.createDataFrame([("Salary", 2030, 1, 0.0)],
                                   "category string, year int, month int, value double")
    years = {r.year for r in C.cashflow_bars(income, micro_ledger).collect()}
    assert years == {2026}


HOLD = "asset_name string, category string, link string, year int, month int, quantity double"
PRICE = "asset_name string, year int, month int, price double"
LIQ = "asset_name string, category string, currency string, year int, month int, value double"
CRED = "name string, currency string, year int, month int, value double"


def test_position_value(spark):
    h = spark.createDataFrame([("A", "Bonds", "", 2026, 1, 10.0), ("B", "Bonds", "", 2026, 1, 10.0)], HOLD)
    p = spark.createDataFrame([("A", 2026, 1, 2.5)], PRICE)
    got = {r.asset_name: r.value for r in N.position_value(h, p).collect()}
    assert got == {"A": 25.0, "B": None}
    tot = {r.asset_name: r.value for r in N.value_table_totals(h, p).collect()}
    assert tot == {"A": 25.0, "B": None, "Total": 25.0}


def test_networth_change_golden(spark):
    h = spark.createDataFrame([], HOLD)
    p = spark.createDataFrame([], PRICE)
    liq = spark.createDataFrame([("Bank", "Cash", "E", 2026, m, v) for m, v in
                                 [(1, 100.0), (2, 150.0), (3, 0.0), (4, -40.0), (5, -20.0)]], LIQ)
    c = spark.createDataFrame([], CRED)
    t = {(r.month, r.row): r.value for r in N.networth_table(h, p, liq, c).collect()}
    expect = {1: (100, None), 2: (50, 50.0), 3: (None, None), 4: (-40, None), 5: (20, -50.0)}
    for m, (chg, pct) in expect.items():
        assert t[(m, "NW Change")] == chg and t[(m, "% NW Change")] == pct
    assert t[(6, "NW Change")] is None and t[(6, "Net Worth")] == 0.0


def test_networth_previous_december(spark):
    h = spark.createDataFrame([], HOLD)
    p = spark.createDataFrame([], PRICE)
    liq = spark.createDataFrame([("Bank", "Cash", "E", 2025, 12, 200.0), ("Bank", "Cash", "E", 2026, 1, 250.0)],
                                LIQ)
    c = spark.createDataFrame([("Loan", "E", 2026, 1, -50.0)], CRED)
    t = {(r.year, r.month, r.row): r.value for r in N.networth_table(h, p, liq, c).collect()}
    assert t[(2026, 1, "Net Worth")] == 200.0
    assert t[(2026, 1, "NW Change")] == 0.0 or t[(2026, 1, "NW Change")] is not None


def test_networth_evolution_and_allocation(spark):
    h = spark.createDataFrame([("A", "Stocks/ETF", "", 2026, 1, 3.0)], HOLD)
    p = spark.createDataFrame([("A", 2026, 1, 1.005)], PRICE)
    liq = spark.createDataFrame([("Bank", "Cash", "E", 2026, 1, 10.0)], LIQ)
    c = spark.createDataFrame([("Loan", "E", 2026, 1, -4.0)], CRED)
    ev = {(r.month, r.series): r.value for r in N.networth_evolution(h, p, liq, c).collect()}
    assert ev[(1, "Stocks/ETF")] == 3.02 and ev[(1, "Net Worth")] == 9.02
    al = {(r.month, r.slice): r.value for r in N.allocation(h, p, liq, c).collect()}
    assert al == {(1, "Stocks/ETF"): 3.02, (1, "Liquidity"): 10.0, (1, "Debts"): 4.0}


def test_networth_changes_telescope(spark):
    h = spark.createDataFrame([], HOLD)
    p = spark.createDataFrame([], PRICE)
    liq = spark.createDataFrame([("Bank", "Cash", "E", 2026, m, v) for m, v in
                                 [(1, 100.0), (2, 150.0), (3, 130.0), (4, 400.0)]], LIQ)
    c = spark.createDataFrame([], CRED)
    t = {(r.month, r.row): r.value for r in N.networth_table(h, p, liq, c).collect()}
    # Over a run of non-zero months the changes add up to last minus the month before the run.
    assert sum(t[(m, "NW Change")] for m in range(1, 5)) == t[(4, "Net Worth")] - 0.0


def test_networth_by_ledger(spark):
    h = spark.createDataFrame([], HOLD + ", lid int")
    p = spark.createDataFrame([], PRICE + ", lid int")
    liq = spark.createDataFrame([("Bank", "Cash", "E", 2026, 1, 10.0, 1), ("Bank", "Cash", "E", 2025, 12, 5.0, 2)],
                                LIQ + ", lid int")
    c = spark.createDataFrame([], CRED + ", lid int")
    t = {(r.lid, r.year, r.month, r.row): r.value
         for r in N.networth_table(h, p, liq, c, by=["lid"]).collect()}
    assert t[(1, 2026, 1, "NW Change")] == 10.0 and (1, 2025, 12, "Net Worth") not in t
    assert t[(2, 2025, 12, "Net Worth")] == 5.0 and (2, 2026, 1, "Net Worth") not in t
