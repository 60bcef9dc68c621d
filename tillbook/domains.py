"""Fixed value domains.

FIXED VALUES: the lists and maps below must equal the tracked application's
for results to match.  They are kept together, in their natural order.
"""

from __future__ import annotations

# ---- FIXED VALUES (must match the reference application) -----------------

# Category casing exceptions: lower-case spelling -> display spelling.
CASING_EXCEPTIONS: dict[str, str] = {
    "tv": "TV",
    "otherexpenses": "OtherExpenses",
    "mrstuff": "MrStuff",
    "techdonations": "TechDonations",
    "othergroceries": "OtherGroceries",
    "condofee": "CondoFee",
    "takeaway": "TakeAway",
    "mrclothing": "MrClothing",
    "mrbooks": "MrBooks",
    "mrleisure": "MrLeisure",
    "mrlearning": "MrLearning",
    "otherleisure": "OtherLeisure",
    "otherfees": "OtherFees",
    "unatantum": "Unatantum",
    "charityenv": "CharityEnv",
    "charityhum": "CharityHum",
    "patreon-like": "Patreon-Like",
}

# Display order of primary categories in the year summary.
PRIMARY_DISPLAY_ORDER: list[str] = [
    "Housing",
    "Health",
    "Groceries",
    "Transport",
    "Lunchbreak",
    "Out",
    "Travel",
    "Baby",
    "Clothing",
    "Leisure",
    "Gifts",
    "Fees",
    "OtherExpenses",
    "Missioni",
]

# Cashflow rows: user-set income categories, then derived rows.
INCOME_CATEGORIES: list[str] = [
    "Salary",
    "Interests Bank account",
    "Dividendi e Cedole",
    "Other",
]
DERIVED_CASHFLOW_ROWS: list[str] = ["Income", "Spending", "Saving", "Saving %"]

# Valid categories of investment holdings and of liquidity balances.
INVESTMENT_CATEGORIES: list[str] = ["Stocks/ETF", "Commodities", "Bonds"]
LIQUIDITY_CATEGORIES: list[str] = ["Bank/Broker account", "Cash", "Other"]

TOTAL_LABEL = "Total"
DEFAULT_CURRENCY = "E"
REF_CURRENCY_RATE = 1.0
LEDGER_FILE_SUFFIX = "_detailed_expenses.parquet"
PAGE_SIZE = 50
RECURRING_DAY_MIN, RECURRING_DAY_MAX = 1, 28
MONTHS = list(range(1, 13))
MONTH_COLUMNS = [f"{m:02d}" for m in MONTHS]

# ---- end of fixed values ---------------------------------------------------

KINDS = ("primary", "secondary")


def category_column(kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"kind must be 'primary' or 'secondary', got {kind!r}")
    return f"{kind}_category"
