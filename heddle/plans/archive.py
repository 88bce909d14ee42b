"""The archive's registered queries and their SQL."""

from . import checks, documents, graphs, lookups, retention  # noqa: F401
from .base import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
