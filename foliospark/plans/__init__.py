"""Registered queries and their SQL oracles."""

from . import answering, chat, ingest, retrieval

_PLANS = (retrieval, ingest, answering, chat)
QUERIES = {k: v for plan in _PLANS for k, v in plan.QUERIES.items()}
ORACLE_SQL = {k: v for plan in _PLANS for k, v in plan.ORACLE_SQL.items()}
