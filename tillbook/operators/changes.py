"""Change batches: J1, J5, J8 and M1-M16.

The application edits one cell or row per call and raises on bad input.
Here every edit kind is a batch operator ``apply_x(table, changes) ->
(table', rejects)``: ``rejects`` holds the refused change rows with a
``reason``.  Within a batch, ``seq`` orders changes: the last write per key
wins for "set", the first one wins for "add" and "rename".

Scale notes: "first/last per key" is an aggregation (``min_by`` /
``max_by``), which combines map-side, so a hot key never lands whole in one
task.  A batch is worked out once, stored, and broadcast when its counted
rows are few, so the table it changes is joined without a shuffle (edits, cell updates, attributes); mappings and
known categories, themselves small, take one full outer join.  New ids come from a scalar
subquery (``max(id) + 1``), evaluated once by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.domains import DEFAULT_CURRENCY, INCOME_CATEGORIES, MONTHS, RECURRING_DAY_MAX, \
    RECURRING_DAY_MIN
from tillbook.functions.scalars import date_from_day_or_iso, mapping_key, normalize_category, \
    safe_date, to_ref_currency
from tillbook.operators.categories import resolve_categories
from tillbook.session import stored


def _split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with a null ``reason`` are accepted; the others are rejects."""
    tagged = df.withColumn("reason", reason)
    return (tagged.where(F.col("reason").isNull()).drop("reason"),
            tagged.where(F.col("reason").isNotNull()))


def _first_per_key(df: DataFrame, keys: Sequence[str], order: str = "seq",
                   last: bool = False) -> tuple[DataFrame, DataFrame]:
    """Keep the first (or last) row per key by ``order``; every other row is a reject.

    Rejects: rows with a null key ("missing <key>"), and the rows that did not win ("superseded in batch"), one reject
    for each refused row.  A tie on ``order`` is decided by the whole row, so task order never picks the winner.
    """
    cols = list(df.columns)
    named = F.coalesce(*[F.when(F.col(k).isNull(), F.lit(f"missing {k}")) for k in keys], F.lit(None).cast("string"))
    ok, missing = _split(df, named)
    pick = F.max if last else F.min
    row = F.struct(*[F.col(c) for c in cols])
    won = ok.groupBy(*keys).agg(pick(F.struct(F.col(order).alias("_order"), row.alias("_row"))).alias("_w")).select("_w._row.*").select(*cols)
    losers = ok.select(*cols).exceptAll(won).withColumn("reason", F.lit("superseded in batch"))
    return won, losers.unionByName(missing.select(*cols, "reason"))


#: A resolved batch of up to so many rows and bytes of files is broadcast, so the table it changes is not shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 32 << 20


def _resolved(batch: DataFrame, name: str) -> DataFrame:
    """A batch worked out once and stored; broadcast when its counted rows and its files are small, else joined by a shuffle."""
    once = stored(batch, name)
    return F.broadcast(once) if _few(once) else once


def _few(once: DataFrame) -> bool:
    """Whether a stored batch is small by its files and its counted rows."""
    size = int(str(once._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= BROADCAST_BYTES and once.count() <= BROADCAST_ROWS


# --------------------------------------------------------------------------
# Expenses
# --------------------------------------------------------------------------

def enrich_expenses(batch: DataFrame, mappings: DataFrame,
                    by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """J1 + F3 + F1 + F5 + P10: turn raw expense changes into ledger rows.

    ``batch``: ``by..., seq, expense_name, year, month, expense_day,
    expense_amount, currency, primary_category, secondary_category`` (the
    categories and currency may be null).  The mapping (``name_key``,
    categories) is looked up by the stripped, lower-cased name and fills
    each missing side.  No mapping: a missing primary is a reject, a missing
    secondary becomes "".  An impossible date is a reject.
    """
    ok, rejects = _split(enrichment(batch, mappings, by).drop("reason"), F.col("_reason"))
    return (ledger_rows_of(ok, [*by, "seq"]), rejects.select(*batch.columns, "reason"))


def enrichment(batch: DataFrame, mappings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The batch (a table or a stream) with its looked-up ``_date``, ``_pri``, ``_sec`` and the ``_reason`` to refuse a row (null: none)."""
    m = mappings.select(*by, "name_key", F.col("primary_category").alias("_mp"),
                        F.col("secondary_category").alias("_ms"), F.lit(True).alias("_hit"))
    j = batch.withColumn("name_key", mapping_key("expense_name")).join(m, [*by, "name_key"], "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    pri = F.when(F.col("primary_category").isNotNull(), F.col("primary_category")) \
        .when(hit, F.col("_mp"))
    sec = F.when(F.col("secondary_category").isNotNull(), F.col("secondary_category")) \
        .when(hit, F.col("_ms")).otherwise(F.lit(""))
    d = safe_date("year", "month", "expense_day")
    reason = (F.when(pri.isNull(), F.lit("no mapping and no primary_category"))
              .when(d.isNull(), F.lit("invalid date")))
    return j.select(*batch.columns, d.alias("_date"), pri.alias("_pri"), sec.alias("_sec"), reason.alias("_reason"))


def ledger_rows_of(enriched: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Ledger rows of accepted ``enrichment`` rows, with the columns ``keep`` before them."""
    return enriched.select(
        *keep,
        "expense_name",
        F.col("_date").alias("expense_date"),
        F.col("expense_amount"),
        F.coalesce("currency", F.lit(DEFAULT_CURRENCY)).alias("currency"),
        to_ref_currency("expense_amount").alias("expense_in_ref_currency"),
        normalize_category("_pri").alias("primary_category"),
        normalize_category("_sec").alias("secondary_category"),
        F.year("_date").alias("year"), F.month("_date").alias("month"))


def next_id(table: DataFrame, id_col: str) -> Column:
    """``max(id) + 1`` of a table as a scalar subquery (0 for an empty table)."""
    return table.select(F.coalesce(F.max(id_col) + 1, F.lit(0)).cast("long")).scalar()


def append_expenses(ledger: DataFrame, batch: DataFrame, mappings: DataFrame,
                    by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """M1 + U1: enrich the batch and append it; new ids are ``max(id)+1+seq``.

    ``seq`` tells the rows of a ledger's batch apart: of rows that share one (or have none) the first by content is taken and the others are
    rejects, so ids stay unique within each ledger (``by``)."""
    new, rejects = new_expenses(ledger, batch, mappings, by)
    return ledger.unionByName(new, allowMissingColumns=True), rejects


def new_expenses(ledger: DataFrame, batch: DataFrame, mappings: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The rows that ``append_expenses`` adds, and its rejects."""
    once, repeated = _first_per_key(batch, [*by, "seq"])
    ok, rejects = enrich_expenses(once, mappings, by)
    rejects = rejects.unionByName(repeated)
    base = next_id(ledger, "expense_id")
    return ok.withColumn("expense_id", base + F.col("seq").cast("long")).drop("seq"), rejects


def delete_expenses(ledger: DataFrame, ids: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """M2: drop the rows whose ``expense_id`` is listed."""
    return ledger.join(ids.select(*by, "expense_id"), [*by, "expense_id"], "left_anti")


EDITABLE = ["expense_name", "expense_date", "expense_amount", "currency",
            "primary_category", "secondary_category"]


def edit_expenses(ledger: DataFrame, edits: DataFrame,
                  by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """M3: edit rows by id; the last edit per id wins; null means "unchanged".

    ``expense_date`` is text: a bare day of the row's month or an ISO date.
    A new amount also resets the reference-currency amount.  Category text
    resolves (F2) against the spellings already used in the row's month.
    Unknown ids and impossible dates are rejects (the whole edit).

    Rows without an accepted edit stay exactly as they are; a row with a new date moves to that date's
    year and month.

    Plan (the batch is small, the ledger is not):
      1. last edit per id, worked out once and (when its counted size allows) broadcast: the
         ledger is scanned for the edited ids only and is not shuffled;
      2. dates and categories are resolved on those rows; spellings are taken only from the months they touch;
      3. the resolved edits are broadcast the same way and applied by ONE left join.
    """
    resolved, rejects = resolved_edits(ledger, edits, by)
    return with_edits(ledger, resolved, by), rejects


def with_edits(ledger: DataFrame, resolved: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The ledger with resolved edits applied by one left join."""
    j = ledger.join(resolved, [*by, "expense_id"], "left")
    new_of = {"expense_name": "_n_name", "expense_date": "_n_date", "expense_amount": "_n_amount",
              "currency": "_n_currency", "expense_in_ref_currency": "_n_ref",
              "primary_category": "_n_pri", "secondary_category": "_n_sec", "year": "_n_year", "month": "_n_month"}
    return j.select(*[F.coalesce(F.col(new_of[c]), F.col(c)).alias(c) if c in new_of else F.col(c) for c in ledger.columns])


def resolved_edits(ledger: DataFrame, edits: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Steps 1 and 2 of ``edit_expenses``: the new values by id, stored and size-checked, and the rejects."""
    keys = [*by, "expense_id"]
    month_keys = [*by, "year", "month"]
    latest, refused = _first_per_key(edits, keys, last=True)
    latest = _resolved(latest, "edits")
    found = _resolved(ledger.select(*keys, "year", "month").join(latest, keys), "edited-rows")
    missing = latest.join(found.select(*keys), keys, "left_anti").select(*edits.columns) \
        .withColumn("reason", F.lit("expense not found"))
    new_date = date_from_day_or_iso(F.col("expense_date"), F.col("year"), F.col("month"))
    info = found.withColumn("_date", new_date).withColumn(
        "_bad", F.col("expense_date").isNotNull() & F.col("_date").isNull())
    bad_rows = info.where("_bad").select(*edits.columns).withColumn("reason", F.lit("invalid date"))
    good = info.where(~F.col("_bad"))
    touched = F.broadcast(good.select(*month_keys).distinct()) if found.count() <= BROADCAST_ROWS else good.select(*month_keys).distinct()
    stacked = (ledger.join(touched, month_keys, "left_semi")
               .select(*month_keys, F.inline(F.array(
                   F.struct(F.lit("primary_category").alias("_kind"), F.col("primary_category").alias("_c")),
                   F.struct(F.lit("secondary_category").alias("_kind"),
                            F.col("secondary_category").alias("_c"))))))
    lookup = stored(stacked.where(F.col("_c").isNotNull() & (F.col("_c") != ""))
                    .groupBy(*month_keys, "_kind", F.lower("_c").alias("_k")).agg(F.min("_c").alias("_spelling")), "spellings")
    for kind in ("primary_category", "secondary_category"):
        existing = lookup.where(F.col("_kind") == kind).select(*month_keys, F.col("_spelling").alias("_e"))
        good = resolve_categories(good, kind, existing, "_e", out=f"_res_{kind}", by=month_keys)
    amount = F.col("expense_amount")
    resolved = _resolved(good.select(
        *keys,
        F.col("expense_name").alias("_n_name"), F.col("_date").alias("_n_date"),
        amount.alias("_n_amount"), F.col("currency").alias("_n_currency"),
        F.when(amount.isNotNull(), to_ref_currency(amount)).alias("_n_ref"),
        F.year("_date").alias("_n_year"), F.month("_date").alias("_n_month"),
        F.col("_res_primary_category").alias("_n_pri"), F.col("_res_secondary_category").alias("_n_sec")), "resolved-edits")
    return resolved, missing.unionByName(refused).unionByName(bad_rows)


# --------------------------------------------------------------------------
# Cell updates on the yearly tables (income, holdings, prices, balances)
# --------------------------------------------------------------------------

def upsert_cells(table: DataFrame, changes: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Replace ``value`` at ``keys`` by the change value, inserting missing
    cells; other columns of an inserted cell come from the change row.

    Plan: the changes are worked out once and broadcast when few; stored cells take their value by a left
    join, and changes that met no stored cell are added.  The table is not shuffled for a small batch.
    """
    ch = _resolved(changes, "cells")
    met = _resolved(table.select(*keys).join(ch.select(*keys), list(keys), "left_semi").distinct(), "met-cells")
    return _with_cells(table, ch, ch.join(met, list(keys), "left_anti"), keys, value)


def _with_cells(table: DataFrame, ch: DataFrame, fresh: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The table with the values of ``ch`` at its cells, and the cells ``fresh`` added."""
    new = ch.select(*keys, F.col(value).alias("_v"), F.lit(True).alias("_set"))
    j = table.join(new, list(keys), "left")
    updated = j.select(*[F.when(F.col("_set"), F.col("_v")).otherwise(F.col(value)).alias(value) if c == value else F.col(c)
                         for c in table.columns])
    added = fresh.select(
        *[(F.col(c) if c in ch.columns else F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    return updated.unionByName(added)


def set_income(income: DataFrame, changes: DataFrame,
               by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """M4: set income cells ``(by..., seq, year, month, category, value)``;
    the category must be one of the 4 income categories, the month 1..12;
    last change per cell wins."""
    reason = (F.when(~F.col("category").isin(INCOME_CATEGORIES), F.lit("invalid income category"))
              .when(~F.col("month").isin(MONTHS), F.lit("month out of range")))  # nulls: see _first_per_key
    ok, bad = _split(changes, reason)
    keys = [*by, "year", "month", "category"]
    latest, superseded = _first_per_key(ok, keys, last=True)
    return upsert_cells(income, latest, keys, "value"), bad.unionByName(superseded)


def _entity_exists(changes: DataFrame, table: DataFrame, keys: Sequence[str]) -> Column:
    """Mark changes whose entity exists in ``table`` (adds column ``_exists``); the table is cut to the batch's entities before it is shuffled."""
    asked = _resolved(changes.select(*keys).distinct(), "asked-entities")
    present = _resolved(table.select(*keys).join(asked, list(keys), "left_semi").distinct(), "present-entities").withColumn("_exists", F.lit(True))
    return changes.join(present, list(keys), "left") \
        .withColumn("_exists", F.coalesce("_exists", F.lit(False)))


def set_values(table: DataFrame, changes: DataFrame, name_col: str, value: str,
               by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Set quantity, price or balance cells ``(by..., seq, year, month,
    <name>, <value>)``; the entity must exist in that year; month 1..12;
    last change per cell wins.

    Plan: changes are reduced to the last one per cell (an aggregation, so a hot cell never gathers in one task),
    stored and broadcast when few.  The table is read once for the batch's entities (do they exist, their attributes, their
    months, which tell the cells to add) and joined once to apply the cells; it is not shuffled for a small batch.
    """
    ok, bad = _split(changes, F.when(~F.col("month").isin(MONTHS), F.lit("month out of range")))
    cell = [*by, "year", "month", name_col]
    ent = [*by, "year", name_col]
    latest, refused = _first_per_key(ok, cell, last=True)
    latest = _resolved(latest, "values")
    attrs = [c for c in table.columns if c not in (*cell, value)]
    # The months as bits, and first per entity with its attributes: numbers fold by hash, where sets and texts sort every row.
    held = F.bit_or(F.when(F.col("month").isin(MONTHS), F.expr("shiftleft(1, cast(month AS int))")).otherwise(F.lit(0)))
    known = table.select(*ent, "month", *attrs).join(latest.select(*ent), ent, "left_semi").groupBy(*ent, *attrs).agg(held.alias("_months"))
    if attrs:
        known = known.groupBy(*ent).agg(F.bit_or("_months").alias("_months"), *[F.min(c).alias(f"_of_{c}") for c in attrs])
    checked = _resolved(latest.join(known, ent, "left"), "checked-values")
    accepted = checked.where("_months IS NOT NULL").select(
        *cell, "_months", *[F.col(f"_of_{c}").alias(c) for c in attrs], F.col(value).cast(table.schema[value].dataType).alias(value))
    notfound = checked.where("_months IS NULL").withColumn("reason", F.lit("not found"))
    out = _with_cells(table, accepted, accepted.where(F.getbit("_months", F.col("month").cast("int")) == 0), cell, value)
    return out, bad.unionByName(refused).unionByName(notfound.select(*changes.columns, "reason"))


def set_attribute(table: DataFrame, changes: DataFrame, name_col: str, attr: str,
                  valid: Sequence[str] | None = None,
                  by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """M8 / M9: set an entity attribute (category, link) for every month of
    the entity's year; the entity must exist; values may be restricted to a
    valid list; last change per entity wins.

    Plan: last change per entity (an aggregation), stored and broadcast when few; one left join
    gives table rows the new value, changes that met no table row are "not found".
    """
    ent = [*by, "year", name_col]
    if valid is not None:
        ok, bad = _split(changes, F.when(F.col(attr).isNull() | ~F.col(attr).isin(list(valid)), F.lit(f"invalid {attr}")))
    else:
        ok, bad = changes, changes.withColumn("reason", F.lit(None).cast("string")).where(F.lit(False))
    latest, superseded = _first_per_key(ok, ent, last=True)
    latest = _resolved(latest, "attributes")
    out = table.join(latest.select(*ent, F.col(attr).alias("_new"), F.lit(True).alias("_chg")), ent, "left") \
        .withColumn(attr, F.when(F.col("_chg"), F.col("_new")).otherwise(F.col(attr))).select(*table.columns)
    met = _resolved(table.select(*ent).join(latest.select(*ent), ent, "left_semi").distinct(), "met-entities")
    notfound = latest.join(met, ent, "left_anti").withColumn("reason", F.lit("not found"))
    return out, bad.unionByName(superseded).unionByName(notfound.select(*changes.columns, "reason"))


def add_entities(table: DataFrame, adds: DataFrame, name_col: str, value: str,
                 valid: Sequence[str] | None = None, category_col: str = "category",
                 by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M5 + R3: add entities ``(by..., seq, year, <name>, <attrs>...)`` with 12
    zero months; the name must be unused in that year and the category valid;
    the first add per name wins.  Returns (table', added rows, rejects)."""
    ent = [*by, "year", name_col]
    marked = _entity_exists(adds, table, ent)
    reason = F.when(F.col("_exists"), F.lit("already exists"))
    if valid is not None:
        reason = F.when(F.col(category_col).isNull() | ~F.col(category_col).isin(list(valid)),
                        F.lit("invalid category")).otherwise(reason)
    ok, bad = _split(marked, reason)
    ok, bad = ok.drop("_exists"), bad.drop("_exists")
    first, superseded = _first_per_key(ok, ent)
    attrs = [c for c in table.columns if c not in (*ent, "month", value)]
    added = (first.select(*ent, *attrs)
             .withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12))))
             .withColumn(value, F.lit(0.0))
             .select(*table.columns))
    return table.unionByName(added), added, bad.unionByName(superseded)


def remove_entities(table: DataFrame, removes: DataFrame, name_col: str,
                    by: Sequence[str] = ()) -> DataFrame:
    """M6: remove entities ``(by..., year, <name>)``; absent names are a no-op."""
    ent = [*by, "year", name_col]
    return table.join(removes.select(*ent), ent, "left_anti")


def rename_entities(table: DataFrame, renames: DataFrame, name_col: str,
                    by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """M7: rename ``(by..., seq, year, old_name, new_name)``.

    The old name must exist; the new one must be free unless equal.  Checks
    run against the table before the batch; one rename per old name and per
    new name (the first by ``seq``) is accepted.  Apply the result to every
    table of the entity (holdings and prices together) with ``apply_renames``.

    Plan: the batch is worked out once and stored.  The table's names are cut to a small batch's names by a broadcast, else
    taken whole (cutting them would shuffle the table twice); the accepted renames are stored and broadcast when few.
    """
    yk = [*by, "year"]
    renames = stored(renames, "renames")
    names = table.select(*yk, F.col(name_col).alias("_n"))
    if _few(renames):
        asked = renames.select(*yk, F.explode(F.array("old_name", "new_name")).alias("_n")).distinct()
        names = names.join(F.broadcast(asked), [*yk, "_n"], "left_semi")
    names = _resolved(names.distinct(), "known-names").withColumn("_hit", F.lit(True))
    old = names.select(*yk, F.col("_n").alias("old_name"), F.col("_hit").alias("_old_ok"))
    new = names.select(*yk, F.col("_n").alias("new_name"), F.col("_hit").alias("_new_taken"))
    r = renames.join(old, [*yk, "old_name"], "left").join(new, [*yk, "new_name"], "left").select(*renames.columns, "_old_ok", "_new_taken")
    reason = (F.when(F.col("old_name").isNull() | F.col("new_name").isNull(), F.lit("missing name"))
              .when(F.col("_old_ok").isNull(), F.lit("not found"))
              .when(F.col("_new_taken") & (F.col("new_name") != F.col("old_name")),
                    F.lit("already exists")))
    ok, bad = _split(r, reason)
    ok, bad = ok.drop("_old_ok", "_new_taken"), bad.drop("_old_ok", "_new_taken")
    first_old, sup1 = _first_per_key(ok, [*yk, "old_name"])
    first_new, sup2 = _first_per_key(first_old, [*yk, "new_name"])
    return _resolved(first_new, "accepted-renames"), bad.unionByName(sup1).unionByName(sup2)


def apply_renames(table: DataFrame, accepted: DataFrame, name_col: str,
                  by: Sequence[str] = ()) -> DataFrame:
    """Apply accepted renames (from ``rename_entities``) to a table."""
    yk = [*by, "year"]
    m = accepted.select(*yk, F.col("old_name").alias(name_col), F.col("new_name").alias("_to"))
    return (table.join(m, [*yk, name_col], "left")
            .withColumn(name_col, F.coalesce("_to", name_col)).select(*table.columns))


# --------------------------------------------------------------------------
# Recurring templates
# --------------------------------------------------------------------------

def add_recurring(templates: DataFrame, adds: DataFrame,
                  by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Add templates ``(by..., seq, expense_name, expense_day,
    expense_amount, currency, primary_category, secondary_category)``; the
    day must be 1..28; both categories are normalised (F1); ids are
    ``max(template_id) + 1 + seq``."""
    day = F.col("expense_day")
    reason = F.when(day.isNull() | (day < RECURRING_DAY_MIN) | (day > RECURRING_DAY_MAX),
                    F.lit("day outside 1..28"))
    ok, bad = _split(adds, reason)
    ok, repeated = _first_per_key(ok, [*by, "seq"])  # ids come from seq
    bad = bad.unionByName(repeated)
    base = next_id(templates, "template_id")
    new = ok.select(
        *by, (base + F.col("seq").cast("long")).alias("template_id"), "expense_name",
        F.col("expense_day").cast("long").alias("expense_day"), "expense_amount",
        F.coalesce("currency", F.lit(DEFAULT_CURRENCY)).alias("currency"),
        normalize_category("primary_category").alias("primary_category"),
        normalize_category(F.coalesce("secondary_category", F.lit(""))).alias("secondary_category"))
    return templates.unionByName(new), bad


def remove_recurring(templates: DataFrame, ids: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Drop templates by id."""
    return templates.join(ids.select(*by, "template_id"), [*by, "template_id"], "left_anti")


def apply_recurring(ledger: DataFrame, templates: DataFrame, targets: DataFrame,
                    by: Sequence[str] = ()) -> DataFrame:
    """M13 + J5 + F5 + F6: the rows that applying the templates to each
    ledger's target month adds.

    ``targets``: ``(by..., year, month)``, one month per ledger (the latest
    is used if several are given), joined many-to-one onto the templates.
    A template is skipped when the month already has an expense with the
    same name on the same day, or when an earlier template (lower id) has
    the same name and day.  The result carries ``template_id`` (the order
    in which the application adds them).
    """
    if not by:
        raise ValueError("apply_recurring needs `by`; use apply_recurring_month for one ledger")
    tgt = _resolved(targets.groupBy(*by).agg(F.max(F.struct("year", "month")).alias("_t"))
                    .select(*by, "_t.year", "_t.month"), "targets")
    # Templates are wide rows, often widened by a join in the tasks that make them; dealt anew, a task of the
    # aggregation holds as many of them as a shuffle deals it (by template, so a hot name and day is still combined first).
    cand = _first_templates(templates.repartition(*by, "expense_name", "expense_day", "template_id"), by).join(tgt, list(by))
    # Only the target months matter; distinct() then combines map-side, so a hot (name, day) shrinks
    # to one row before the anti join's shuffle.
    present = ledger.join(tgt, [*by, "year", "month"], "left_semi").select(*by, "year", "month", "expense_name",
                            F.dayofmonth("expense_date").cast("long").alias("expense_day")).distinct()
    new = cand.join(present, [*by, "year", "month", "expense_name", "expense_day"], "left_anti")
    return _template_rows(new, by)


def apply_recurring_month(ledger: DataFrame, templates: DataFrame, year: int, month: int,
                          by: Sequence[str] = ()) -> DataFrame:
    """M13 for one month given as literals (the application's own call)."""
    cand = _first_templates(templates, by).withColumns({"year": F.lit(int(year)), "month": F.lit(int(month))})
    present = (ledger.where((F.col("year") == year) & (F.col("month") == month))
               .select(*by, "year", "month", "expense_name",
                       F.dayofmonth("expense_date").cast("long").alias("expense_day")).distinct())
    new = cand.join(present, [*by, "year", "month", "expense_name", "expense_day"], "left_anti")
    return _template_rows(new, by)


def _first_templates(templates: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per (ledger, name, day) the template with the lowest id (an aggregate)."""
    rest = [c for c in templates.columns if c not in (*by, "expense_name", "expense_day")]
    return (templates.groupBy(*by, "expense_name", "expense_day")
            .agg(F.min_by(F.struct(*rest), F.col("template_id")).alias("_t"))
            .select(*by, "expense_name", "expense_day", "_t.*"))


def _template_rows(new: DataFrame, by: Sequence[str]) -> DataFrame:
    d = safe_date("year", "month", "expense_day")
    return new.select(
        *by, "template_id", "expense_name", d.alias("expense_date"), "expense_amount",
        F.coalesce("currency", F.lit(DEFAULT_CURRENCY)).alias("currency"),
        to_ref_currency("expense_amount").alias("expense_in_ref_currency"),
        normalize_category("primary_category").alias("primary_category"),
        normalize_category("secondary_category").alias("secondary_category"),
        F.col("year").cast("int").alias("year"), F.col("month").cast("int").alias("month"))


# --------------------------------------------------------------------------
# Mappings and known categories
# --------------------------------------------------------------------------

def _apply_keyed(table: DataFrame, first: DataFrame, keys: Sequence[str], reason_of,
                 added_cols: dict) -> tuple[DataFrame, DataFrame]:
    """Apply one add/remove change per key with ONE full outer join.

    ``reason_of(exists)`` gives the reject reason (null = accepted) from the
    change columns and whether the key exists in ``table``.  Returns the new
    table and the rejected changes; the table is read once.
    """
    j = (table.withColumn("_in", F.lit(True))
         .join(first.withColumn("_chg", F.lit(True)), list(keys), "full"))
    exists = F.coalesce(F.col("_in"), F.lit(False))
    changed = F.coalesce(F.col("_chg"), F.lit(False))
    j = j.withColumn("reason", F.when(changed, reason_of(exists)))
    # Null-safe throughout: rows without a change have null change columns.
    accepted = changed & F.col("reason").isNull()
    replaces = accepted & F.coalesce(F.col("op").isin("add", "remove"), F.lit(False))
    keep_old = F.coalesce(F.col("_in"), F.lit(False)) & ~replaces
    add_new = accepted & F.coalesce(F.col("op") == "add", F.lit(False))
    cols = [c for c in table.columns if c not in keys]
    old = j.where(keep_old).select(*keys, *cols)
    new = j.where(add_new).select(*keys, *[added_cols[c].alias(c) for c in cols])
    rejects = j.where(changed & F.col("reason").isNotNull()).select(*first.columns, "reason")
    return old.unionByName(new), rejects


def change_mappings(mappings: DataFrame, changes: DataFrame,
                    by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(by..., seq, op, expense_name, primary_category,
    secondary_category, overwrite)`` with ``op`` in add/remove.

    Keys are the stripped, lower-cased name; stored categories are stripped
    and lower-cased.  One change per key per batch (the first by ``seq``).
    An add of an existing key needs ``overwrite``; removing a missing key is
    a reject.
    """
    ch = (changes.withColumn("name_key", mapping_key("expense_name"))
          .withColumnRenamed("primary_category", "_pri").withColumnRenamed("secondary_category", "_sec"))
    first, superseded = _first_per_key(ch, [*by, "name_key"])

    def reason_of(exists):
        return (F.when(~F.col("op").isin("add", "remove"), F.lit("unknown op"))
                .when((F.col("op") == "add") & exists & ~F.coalesce(F.col("overwrite"), F.lit(False)),
                      F.lit("mapping exists; pass overwrite"))
                .when((F.col("op") == "remove") & ~exists, F.lit("no mapping found")))

    added = {"primary_category": mapping_key(F.coalesce("_pri", F.lit(""))),
             "secondary_category": mapping_key(F.coalesce("_sec", F.lit("")))}
    out, bad = _apply_keyed(mappings, first, [*by, "name_key"], reason_of, added)
    rename = {"_pri": "primary_category", "_sec": "secondary_category"}
    bad = bad.unionByName(superseded).drop("name_key")
    for k, v in rename.items():
        bad = bad.withColumnRenamed(k, v)
    return out, bad


def clear_mappings(mappings: DataFrame) -> DataFrame:
    """Clear all mappings (same schema, no rows)."""
    return mappings.where(F.lit(False))


def change_known_categories(known: DataFrame, changes: DataFrame,
                            by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(by..., seq, op, kind, category)``; adding an exact duplicate or
    removing a missing category is a reject; one change per category per
    batch (the first by ``seq``)."""
    keys = [*by, "kind", "category"]
    first, superseded = _first_per_key(changes, keys)

    def reason_of(exists):
        return (F.when(~F.col("kind").isin("primary", "secondary"), F.lit("invalid kind"))
                .when(~F.col("op").isin("add", "remove"), F.lit("unknown op"))
                .when((F.col("op") == "add") & exists, F.lit("category exists"))
                .when((F.col("op") == "remove") & ~exists, F.lit("category not found")))

    out, bad = _apply_keyed(known, first, keys, reason_of, {})
    return out, bad.unionByName(superseded)


def retire_categories(known: DataFrame, summary: DataFrame, totals: DataFrame, requests: DataFrame,
                      by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Retire categories ``(by..., kind, category)`` from the known list
    and every summary, only when the all-time total (A5, rounded to 2) is 0.

    Requests with a null key and of categories that neither the known list nor a summary holds are rejects; a repeated request counts once.
    Returns (known', summary', rejects)."""
    keys = [*by, "kind", "category"]
    t = totals.select(*keys, F.bround("total", 2).alias("_total"))
    there = known.select(*keys).unionByName(summary.select(*keys)).distinct().withColumn("_there", F.lit(True))
    r = requests.join(t, keys, "left").join(there, keys, "left")
    null_key = F.coalesce(*[F.when(F.col(k).isNull(), F.lit(f"missing {k}")) for k in keys], F.lit(None).cast("string"))
    ok, bad = _split(r, F.coalesce(null_key, F.when(F.coalesce("_total", F.lit(0.0)) != 0, F.lit("category still has expenses"))
                                   .when(F.col("_there").isNull(), F.lit("category not found"))))
    ok, bad = ok.select(*keys), bad.drop("_there")
    return (known.join(ok, keys, "left_anti"), summary.join(ok, keys, "left_anti"),
            bad.drop("_total"))


# --------------------------------------------------------------------------
# Holdings and prices move together (M5-M7)
# --------------------------------------------------------------------------

def add_holdings(holdings: DataFrame, prices: DataFrame, adds: DataFrame, valid: Sequence[str],
                 by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M5 for investments: an accepted asset gets 12 zero quantities and 12
    zero prices.  Returns (holdings', prices', rejects)."""
    h2, added, bad = add_entities(holdings, adds, "asset_name", "quantity", valid=valid, by=by)
    new_prices = added.select(*[F.col(c) for c in prices.columns if c != "price"],
                              F.lit(0.0).alias("price")).select(*prices.columns)
    return h2, prices.unionByName(new_prices), bad


def remove_holdings(holdings: DataFrame, prices: DataFrame, removes: DataFrame,
                    by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """M6 for investments: the asset leaves both tables."""
    return (remove_entities(holdings, removes, "asset_name", by),
            remove_entities(prices, removes, "asset_name", by))


def rename_holdings(holdings: DataFrame, prices: DataFrame, renames: DataFrame,
                    by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M7 for investments: checks run on the holdings; accepted renames apply
    to holdings and prices alike.  Returns (holdings', prices', rejects)."""
    ok, bad = rename_entities(holdings, renames, "asset_name", by)
    return (apply_renames(holdings, ok, "asset_name", by), apply_renames(prices, ok, "asset_name", by), bad)
