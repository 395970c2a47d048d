"""All queries of the catalogue."""

from . import queries_details, queries_history, queries_ledger, queries_retrieval, queries_text  # noqa: F401
from .catalogue import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
