"""All queries of the reference's operators, and the SQL that each must agree with.

A plan module declares a query with ``@query(sql)``; importing the modules fills the two tables.
"""

from __future__ import annotations

from . import log_queries, model_queries, pair_queries, stat_queries, text_queries  # noqa: F401
from .catalog import ORACLES, QUERIES  # noqa: F401
