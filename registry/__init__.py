"""Every operator as a query over the given tables, with its SQL twin where SQL can say it."""

from registry import collecting, evaluating, learning, preparing, texts
from registry.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "collecting", "evaluating", "learning", "preparing", "texts"]
