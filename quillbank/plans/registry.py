"""Queries over the question-bank operators, and the SQL that each is compared with."""

from __future__ import annotations

from quillbank.plans import change_queries, content_queries, edit_queries, record_queries, report_queries  # noqa: F401  (register their queries)
from quillbank.plans.bank_queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
