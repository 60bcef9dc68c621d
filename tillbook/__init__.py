"""tillbook: personal-ledger and net-worth analytics as Spark DataFrame jobs.

Every public operator takes and returns DataFrames.  Most accept ``by``, a
sequence of extra grouping columns (for example ``ledger_id``), so the same
job processes one ledger or millions of them.
"""

__all__ = ["session", "domains", "schemas"]
