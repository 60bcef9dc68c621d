import datetime as dt

from pyspark.sql import functions as F

from tillbook.operators import changes as M
from tests.conftest import rows_of

BATCH = ("seq long, expense_name string, year int, month int, expense_day int, expense_amount double, "
         "currency string, primary_category string, secondary_category string")
MAP = "name_key string, primary_category string, secondary_category string"


def test_mapping_enrichment_golden(spark):
    m = spark.createDataFrame([("pam", "groceries", "supermarket")], MAP)
    b = spark.createDataFrame([
        (1, "Pam", 2026, 2, 1, 1.0, None, None, None),
        (2, "Pam", 2026, 2, 1, 1.0, None, "out", None),
        (3, "Zed", 2026, 2, 1, 1.0, None, "out", None),
        (4, "Zed", 2026, 2, 1, 1.0, None, None, None),
        (5, "Zed", 2026, 2, 1, 1.0, None, None, "x"),
        (6, "Zed", 2026, 2, 30, 1.0, None, "out", None)], BATCH)
    ok, bad = M.enrich_expenses(b, m)
    got = {r.seq: (r.primary_category, r.secondary_category, r.currency) for r in ok.collect()}
    assert got == {1: ("Groceries", "Supermarket", "E"), 2: ("Out", "Supermarket", "E"), 3: ("Out", "", "E")}
    assert {r.seq: r.reason for r in bad.collect()} == {
        4: "no mapping and no primary_category", 5: "no mapping and no primary_category", 6: "invalid date"}


def test_append_assigns_new_ids(spark, micro_ledger):
    m = spark.createDataFrame([], MAP)
    b = spark.createDataFrame([(1, "New", 2026, 3, 2, 9.0, "E", "fees", "bank")], BATCH)
    out, bad = M.append_expenses(micro_ledger, b, m)
    new = out.where("expense_name = 'New'").first()
    assert new.expense_id == 8 and new.primary_category == "Fees" and bad.count() == 0
    assert out.count() == 7


def test_delete_and_edit(spark, micro_ledger):
    ids = spark.createDataFrame([(5,), (6,), (99,)], "expense_id long")
    assert sorted(r.expense_id for r in M.delete_expenses(micro_ledger, ids).collect()) == [1, 2, 3, 4]
    edits = spark.createDataFrame([
        (2, 1, None, "12", 60.0, None, "groceries", None),
        (2, 2, None, None, 61.0, None, None, None),
        (4, 1, "Odder", "31", None, None, None, None),
        (3, 1, None, "2026-02-20", None, None, "custom", None),
        (42, 1, "Ghost", None, None, None, None, None)],
        "expense_id long, seq long, expense_name string, expense_date string, expense_amount double, "
        "currency string, primary_category string, secondary_category string")
    out, bad = M.edit_expenses(micro_ledger, edits)
    rows = {r.expense_id: r for r in out.collect()}
    assert rows[2].expense_amount == 61.0 and rows[2].expense_in_ref_currency == 61.0
    assert rows[2].expense_date == dt.date(2026, 1, 10)  # last edit (seq 2) left the date alone
    assert rows[3].expense_date == dt.date(2026, 2, 20) and rows[3].primary_category == "Custom"
    assert rows[4].expense_name == "Odd"  # impossible date rejects the whole edit
    reasons = sorted(r.reason for r in bad.collect())
    assert reasons == ["expense not found", "invalid date", "superseded in batch"]


def test_set_income(spark):
    inc = spark.createDataFrame([("Salary", 2026, 1, 10.0)], "category string, year int, month int, value double")
    ch = spark.createDataFrame([(1, 2026, 1, "Salary", 20.0), (2, 2026, 1, "Salary", 30.0),
                                (3, 2026, 2, "Other", 5.0), (4, 2026, 13, "Other", 5.0),
                                (5, 2026, 2, "Pension", 1.0)],
                               "seq long, year int, month int, category string, value double")
    out, bad = M.set_income(inc, ch)
    assert rows_of(out, "category", "month", "value") == [("Other", 2, 5.0), ("Salary", 1, 30.0)]
    assert sorted(r.reason for r in bad.collect()) == ["invalid income category", "month out of range",
                                                        "superseded in batch"]


HOLD = "asset_name string, category string, link string, year int, month int, quantity double"


def holdings(spark):
    return spark.createDataFrame([("A", "Bonds", "", 2026, m, 1.0) for m in (1, 2)]
                                 + [("B", "Bonds", "", 2026, 1, 2.0)], HOLD)


def test_rename_rules(spark):
    h = holdings(spark)
    rn = spark.createDataFrame([(1, 2026, "A", "C"), (2, 2026, "B", "C"), (3, 2026, "X", "Y"),
                                (4, 2026, "B", "A"), (5, 2026, "B", "B")],
                               "seq long, year int, old_name string, new_name string")
    ok, bad = M.rename_entities(h, rn, "asset_name")
    assert rows_of(ok, "seq") == [(1,)]
    assert sorted(r.reason for r in bad.collect()) == ["already exists", "not found", "superseded in batch",
                                                        "superseded in batch"]
    assert {r.asset_name for r in M.apply_renames(h, ok, "asset_name").collect()} == {"C", "B"}


def test_set_category_link_values_add_remove(spark):
    h = holdings(spark)
    cat = spark.createDataFrame([(1, 2026, "A", "Stocks/ETF"), (2, 2026, "B", "Crypto"), (3, 2026, "Z", "Bonds")],
                                "seq long, year int, asset_name string, category string")
    out, bad = M.set_attribute(h, cat, "asset_name", "category", valid=["Stocks/ETF", "Bonds"])
    assert {r.asset_name: r.category for r in out.collect()} == {"A": "Stocks/ETF", "B": "Bonds"}
    assert sorted(r.reason for r in bad.collect()) == ["invalid category", "not found"]
    vals = spark.createDataFrame([(1, 2026, 3, "A", 7.0), (2, 2026, 3, "A", 8.0), (3, 2026, 1, "Q", 1.0)],
                                 "seq long, year int, month int, asset_name string, quantity double")
    out, bad = M.set_values(h, vals, "asset_name", "quantity")
    got = {(r.asset_name, r.month): (r.quantity, r.category) for r in out.collect()}
    assert got[("A", 3)] == (8.0, "Bonds") and bad.count() == 2
    adds = spark.createDataFrame([(1, 2026, "N", "Bonds", "l"), (2, 2026, "A", "Bonds", ""),
                                  (3, 2026, "M", "Crypto", "")],
                                 "seq long, year int, asset_name string, category string, link string")
    table, added, bad = M.add_entities(h, adds, "asset_name", "quantity", valid=["Bonds"])
    assert added.count() == 12 and {r.quantity for r in added.collect()} == {0.0}
    assert sorted(r.reason for r in bad.collect()) == ["already exists", "invalid category"]
    rm = spark.createDataFrame([(2026, "A"), (2026, "nope")], "year int, asset_name string")
    assert {r.asset_name for r in M.remove_entities(h, rm, "asset_name").collect()} == {"B"}


TPL = ("template_id long, expense_name string, expense_day long, expense_amount double, currency string, "
       "primary_category string, secondary_category string")


def test_apply_recurring_golden(spark, micro_ledger):
    tpl = spark.createDataFrame([(1, "Rent", 1, 800.0, "E", "Housing", "Rent"),
                                 (2, "Gym", 5, 30.0, "E", "Health", "Gym"),
                                 (3, "Gym", 5, 31.0, "E", "Health", "Gym"),
                                 (4, "Pam", 10, 50.0, "E", "Groceries", "Supermarket")], TPL)
    added = M.apply_recurring_month(micro_ledger, tpl, 2026, 2)
    assert [(r.template_id, r.expense_name, str(r.expense_date)) for r in added.orderBy("template_id").collect()] \
        == [(1, "Rent", "2026-02-01"), (2, "Gym", "2026-02-05")]
    again = micro_ledger.unionByName(added.drop("template_id").withColumn("expense_id", F.lit(0).cast("long")))
    assert M.apply_recurring_month(again, tpl, 2026, 2).count() == 0
    by = M.apply_recurring(micro_ledger.withColumn("lid", F.lit(1)), tpl.withColumn("lid", F.lit(1)),
                           spark.createDataFrame([(1, 2026, 2)], "lid int, year int, month int"), by=["lid"])
    assert by.count() == 2


def test_add_remove_recurring(spark):
    tpl = spark.createDataFrame([(4, "Rent", 1, 800.0, "E", "Housing", "Rent")], TPL)
    adds = spark.createDataFrame([(1, "gym", 5, 30.0, None, "health", None), (2, "x", 29, 1.0, "E", "a", "b")],
                                 "seq long, expense_name string, expense_day long, expense_amount double, "
                                 "currency string, primary_category string, secondary_category string")
    out, bad = M.add_recurring(tpl, adds)
    new = out.where("expense_name = 'gym'").first()
    assert (new.template_id, new.primary_category, new.secondary_category, new.currency) == (6, "Health", "", "E")
    assert bad.count() == 1
    ids = spark.createDataFrame([(4,)], "template_id long")
    assert M.remove_recurring(out, ids).count() == 1


def test_mappings_and_known_categories(spark):
    m = spark.createDataFrame([("pam", "groceries", "supermarket"), ("tv", "housing", "tv")], MAP)
    ch = spark.createDataFrame([
        (1, "add", " PAM ", "x", "y", False), (2, "add", "Zed\t", " Out ", "Bar", False),
        (3, "remove", "nope", None, None, False), (4, "add", "pam", "z", "w", True)],
        "seq long, op string, expense_name string, primary_category string, secondary_category string, "
        "overwrite boolean")
    out, bad = M.change_mappings(m, ch)
    assert rows_of(out) == [("pam", "groceries", "supermarket"), ("tv", "housing", "tv"), ("zed", "out", "bar")]
    assert sorted(r.reason for r in bad.collect()) == ["mapping exists; pass overwrite", "no mapping found",
                                                        "superseded in batch"]
    assert M.clear_mappings(m).count() == 0
    known = spark.createDataFrame([("primary", "Fees"), ("secondary", "Bank")], "kind string, category string")
    kc = spark.createDataFrame([(1, "add", "primary", "Fees"), (2, "add", "primary", "Gifts"),
                                (3, "remove", "secondary", "Nope"), (4, "remove", "primary", "Fees")],
                               "seq long, op string, kind string, category string")
    out, bad = M.change_known_categories(known, kc)
    # One change per key per batch: the rejected add (seq 1) supersedes the remove.
    assert rows_of(out) == [("primary", "Fees"), ("primary", "Gifts"), ("secondary", "Bank")]
    assert sorted(r.reason for r in bad.collect()) == ["category exists", "category not found",
                                                        "superseded in batch"]


def test_retire_only_zero_totals(spark, micro_ledger):
    from tillbook.operators import summaries as S
    summary = S.summaries_long(micro_ledger)
    totals = S.category_totals(summary)
    known = spark.createDataFrame([("primary", "Custom"), ("primary", "Unused")], "kind string, category string")
    req = known
    k2, s2, bad = M.retire_categories(known, summary, totals, req)
    assert rows_of(k2) == [("primary", "Custom")] and bad.count() == 1


def test_tied_seq_is_never_lost(spark):
    inc = spark.createDataFrame([], "category string, year int, month int, value double")
    ch = spark.createDataFrame([(1, 2026, 1, "Salary", 20.0), (1, 2026, 1, "Salary", 30.0)],
                               "seq long, year int, month int, category string, value double")
    out, bad = M.set_income(inc, ch)
    assert out.count() == 1 and bad.count() == 1


PRICE = "asset_name string, year int, month int, price double"


def test_holdings_and_prices_move_together(spark):
    h = holdings(spark)
    p = spark.createDataFrame([("A", 2026, 1, 2.0), ("B", 2026, 1, 3.0)], PRICE)
    adds = spark.createDataFrame([(1, 2026, "N", "Bonds", "")],
                                 "seq long, year int, asset_name string, category string, link string")
    h2, p2, bad = M.add_holdings(h, p, adds, valid=["Bonds"])
    assert p2.where("asset_name = 'N'").count() == 12 and {r.price for r in p2.where("asset_name = 'N'").collect()} == {0.0}
    rm = spark.createDataFrame([(2026, "B")], "year int, asset_name string")
    h3, p3 = M.remove_holdings(h2, p2, rm)
    assert h3.where("asset_name = 'B'").count() == 0 and p3.where("asset_name = 'B'").count() == 0
    rn = spark.createDataFrame([(1, 2026, "A", "Z")], "seq long, year int, old_name string, new_name string")
    h4, p4, bad = M.rename_holdings(h3, p3, rn)
    assert {r.asset_name for r in p4.collect()} == {"Z", "N"} and "Z" in {r.asset_name for r in h4.collect()}
